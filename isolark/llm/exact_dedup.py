"""Exact de-duplication by a 128-bit content hash, with a comparison of bytes.

Rows are grouped by the MD5 of the normalised text, which moves 16 bytes of
hash instead of the text. The byte comparison groups whole texts below their
hash with partial aggregation, so a text that a third of all rows share leaves
each task once; it moves every distinct text once, and its result is a list of
the hashes that stand for more than one text. Those, if any, are split by text.

Defined results: a null text equals an empty one; a null id sorts behind every
other and keeps its row only when all ids of the group are null; of repeated
rows with one id, exactly one stays. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isolark.session import cut_lineage

#: White space that one blank replaces (blank, tab to carriage return).
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(column) -> F.Column:
    return F.regexp_replace(F.coalesce(column, F.lit("")), BLANKS, " ")


def collisions(hashed: DataFrame) -> DataFrame:
    """(hash, norm, variant) for hashes that stand for more than one text; ``variant`` 0 is the first in byte order."""
    distinct = hashed.groupBy("hash", "norm").agg(F.count(F.lit(1)).alias("rows"))
    first = distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("texts"), F.min(F.sha2("norm", 256)).alias("first")).where("texts > 1")
    if first.isEmpty():
        return None
    return distinct.join(first, "hash").select("hash", "norm", F.when(F.sha2("norm", 256) == F.col("first"), "").otherwise(F.sha2("norm", 256)).alias("variant"))


def dedup(docs: DataFrame, content_hash=F.md5) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, row_id.

    ``content_hash`` is a parameter so that tests can force collisions.
    """
    hashed = docs.select("doc_id", normalised(F.col("text")).alias("norm")).withColumn("hash", content_hash("norm"))
    colliding = collisions(hashed)
    if colliding is None:
        lean = hashed.select("doc_id", "hash", F.lit("").alias("variant"), F.sha2("norm", 256).alias("text_sha256"))
    else:
        lean = hashed.join(colliding, ["hash", "norm"], "left").select("doc_id", "hash", F.coalesce("variant", F.lit("")).alias("variant"), F.sha2("norm", 256).alias("text_sha256"))
    lean = cut_lineage(lean.withColumn("row_id", F.monotonically_increasing_id()))
    order = F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), F.col("row_id").alias("row"))
    groups = lean.groupBy("hash", "variant").agg(F.min(order).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return lean.join(groups, ["hash", "variant"]).select(
        "doc_id", F.col("keep.id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("keep.row")).alias("kept"), "text_sha256"
    )


def unique(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all columns; of repeated rows with one id, one."""
    stays = dedup(docs).where("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha256")).distinct()
    digest = "_".join(["text_sha256", *docs.columns])  # no column of docs is called so
    own = docs.withColumn(digest, F.sha2(normalised(F.col("text")), 256))
    same = own["doc_id"].eqNullSafe(stays["keep_id"]) & (own[digest] == stays["keep_sha256"])
    return own.join(stays.hint("shuffle_hash"), same, "left_semi").dropDuplicates(["doc_id", digest]).drop(digest)
