"""Helpers shared by the training-data operators.

Python stages here are ``mapInArrow`` functions. They see one Arrow batch at a
time and cut it into blocks by size of text, so that memory depends neither on
the partition nor on how long single texts are grouped.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isolark.session import shared_folder

#: Code points of text that a Python stage works on at once.
BLOCK_CHARS = 1_500_000
#: Bytes that a Python worker may spend on remembered chunks of text in a task, and those it keeps for the next one.
MEMO_BYTES, MEMO_REST = 80 << 20, 20 << 20
#: Words that a token count remembers before it starts anew.
MEMO_ENTRIES = 700_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(df: DataFrame, *keep: str) -> DataFrame:
    """``keep`` and the whole text; a null text counts as empty."""
    return df.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("text"))


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with Arrow batches bounded in bytes as well as in rows."""
    spark = df.sparkSession
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, str(2**63 - 1), str(2**31 - 1)):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
    return df.mapInArrow(fn, schema)


def everywhere(blocks: DataFrame, sent: DataFrame, count: int) -> DataFrame:
    """Every row of ``blocks`` (``count`` of them, numbered by ``block``) beside every row of ``sent`` of its ``dim``.

    Blocks are dealt into buckets, each of which gets ``sent`` once, by a shuffle: copies for all buckets are more than a
    broadcast holds, though Spark takes them for as small as one. The tasks are costly for their bytes and stay apart.
    """
    tasks = max(1, min(count, int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    buckets = max(1, min(count, 4 * tasks))
    copies = sent.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    dealt = blocks.withColumn("bucket", F.pmod(F.col("block").cast("long"), F.lit(buckets).cast("long")))
    return dealt.repartition(tasks, "dim", "bucket").hint("merge").join(copies.repartition(tasks, "dim", "bucket"), ["dim", "bucket"])


def learned(sample: DataFrame, fn, *order: str):
    """What ``fn`` makes of an iterator over the rows of a bounded sample, in order; a task works it out, so the driver holds no text."""

    def run(batches):
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fn(rows))], pa.binary())], ["model"])

    made = map_batches(sample.repartition(1).sortWithinPartitions(*order), run, "model binary").collect()
    return pickle.loads(made[0]["model"]) if made else fn(iter(()))


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again; its shuffle files go when it is written."""
    return write_table(df, cleanup=True)[0]


def write_table(df: DataFrame, cleanup: bool = False) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read again, with its path; with ``cleanup`` its shuffle files go when it is written."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key)
    conf.set(key, "true" if cleanup else before)
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/isolark-{uuid.uuid4().hex}"
    try:
        df.write.parquet(path)
    finally:
        conf.set(key, before)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables written on the way to a result, each deleted when all that reads it is written itself."""

    def __init__(self):
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        written, path = write_table(df, cleanup=True)
        self.paths[id(written)] = (written, path)
        return written

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            written, path = self.paths.pop(id(table))
            jvm, session = written.sparkSession._jvm, written.sparkSession._jsparkSession
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(session.sessionState().newHadoopConf()).delete(folder, True)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of ``batch`` of about ``limit`` code points, never fewer than one row."""
    lengths = np.cumsum(pc.utf8_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    start, before, n = 0, 0, batch.num_rows
    while start < n:
        end = max(start + 1, int(np.searchsorted(lengths, before + limit, side="right")))
        part = batch.slice(start, end - start)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        start, before = end, int(lengths[end - 1])


def gather(values: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``values[offsets[c]:offsets[c + 1]]`` of ``codes``; with the length of each."""
    lengths = (offsets[1:] - offsets[:-1])[codes]
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return values[:0], lengths
    at = np.repeat(offsets[codes] - (ends - lengths), lengths)
    at += np.arange(ends[-1])
    return values[at], lengths


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches where ``mask`` holds."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0]))))
    return edges[::2], edges[1::2]


def span_text(spans: list[tuple[int, int, str, int]]) -> str:
    """``kind:start:end`` by start, then by order of kinds, joined by commas."""
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in sorted(spans))


def sha256_hex(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def learnable(doc_id: str = "doc_id"):
    """Rows that a model may learn from: crc32 of the id as text, modulo 4, is not 2."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
