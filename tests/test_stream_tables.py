"""Streams over tables in every layout they come in."""

from pathlib import Path

from pyspark.sql import functions as F

import __spark_entry__ as entry


def test_a_table_may_be_a_folder_of_part_files(spark, tmp_path):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, None)], "doc_id long, text string")
    texts.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert entry.queries()["stream_submissions"](spark, str(tmp_path)).collect()[0][0] == 2
    texts.coalesce(1).write.parquet(f"{tmp_path}/one")
    [part] = Path(f"{tmp_path}/one").glob("*.parquet")
    (tmp_path / "file").mkdir()
    part.rename(tmp_path / "file" / "documents.parquet")
    assert entry.queries()["stream_submissions"](spark, f"{tmp_path}/file").collect()[0][0] == 2
    times = F.lit("2024-01-01 05:00:00").cast("timestamp_ntz")
    spark.range(4).select(times.alias("ts"), F.lit("x").alias("event_type")).repartition(2).write.parquet(f"{tmp_path}/events.parquet")
    assert [r.n for r in entry.queries()["status_windows"](spark, str(tmp_path)).collect()] == [4]
