"""Writers: FASTA text, tab-separated reports, JSON snapshots, state tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_fasta(df: DataFrame, path: str, id_column: str = "id", sequence: str = "sequence", compression: str | None = None) -> None:
    lines = df.select(F.concat(F.lit(">"), id_column, F.lit("\n"), sequence).alias("value"))
    writer = lines.write.mode("overwrite")
    (writer.option("compression", compression) if compression else writer).text(path)


def write_report(df: DataFrame, path: str) -> None:
    """Tab-separated text with a header; NULL is written as NA and arrays as ';' lists."""
    flat = df.select(*[F.array_join(c, ";").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    clean = flat.select(*[F.regexp_replace(c, r"[\t\r\n]", " ").alias(c) if t == "string" else F.col(c) for c, t in flat.dtypes])
    clean.write.mode("overwrite").csv(path, sep="\t", header=True, nullValue="NA", emptyValue="")


def snapshot_rows(df: DataFrame, snapshot_id: str, key: str, dataset: str) -> DataFrame:
    """Schemaless snapshot form: one JSON payload per sequence."""
    return df.select(
        F.lit(snapshot_id).alias("snapshot_id"), F.col(key).alias("sequence_id"), F.lit(dataset).alias("dataset"),
        F.to_json(F.struct(*df.columns)).alias("payload"), F.current_timestamp().alias("created_at"),
    )


def write_state(df: DataFrame, root: str, table: str, version: str) -> str:
    """Write the next version of a state table beside the earlier ones."""
    path = f"{root.rstrip('/')}/{table}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def read_state(spark: SparkSession, root: str, table: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{table}/version={version}")
