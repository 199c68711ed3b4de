"""Token counts through a digest cache.

A count depends on the content and on the tokenizer only, so it is stored under
the digests of both. Counting joins the digests of the documents to the stored
counts, encodes each distinct text that is missing once, appends the new counts
to the cache and joins again. The content is taken as it is (null as empty):
this tokenizer counts every white space, so any folding would change counts.

The cache is a Parquet folder in the folder that all executors share. Appends
only add files; if two jobs add the same digest, readers fold the rows.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
come out as often as they come in; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from isolark.llm.common import MEMO_ENTRIES, blocks, map_batches, texts
from isolark.session import cut_lineage, shared_folder

#: A new word starts at a blank after anything but a blank; no piece of the model spans that place.
WORD_START = re.compile("(?<=[^ ▁]) ")
CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"


def tokenizer_version(model_file: str) -> str:
    with open(model_file, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def words(text: str) -> list[str]:
    """The text cut at word starts, each without its leading blank, which the library's own prefix stands for."""
    if "  " in text or "▁ " in text or text[:1] == " ":
        return WORD_START.split(text)
    return text.split(" ")


class Counter:
    """Counts tokens with the library, asking it once for each distinct word of a task."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.library.get_piece_size()):
            if re.search("[^▁]▁", self.library.id_to_piece(i)):
                raise ValueError("a piece spans a word start; words can't be counted one by one")
        self.memo: dict[str, int] = {}

    def __call__(self, batch: list[str]) -> list[int]:
        cut = [words(t) for t in batch]
        fresh = list({w for ws in cut for w in ws} - self.memo.keys())
        if len(self.memo) + len(fresh) > MEMO_ENTRIES:
            self.memo.clear()
            fresh = list({w for ws in cut for w in ws})
        self.memo.update(zip(fresh, map(len, self.library.encode(fresh, num_threads=1)), strict=True))
        # An empty word is a blank with nothing behind it, one piece, unless the whole text is empty.
        self.memo[""] = 1
        of = self.memo.__getitem__
        return [sum(map(of, ws)) if t else 0 for t, ws in zip(batch, cut, strict=True)]


def _count_tokens(model_file: str):
    def run(batches):
        count = Counter(model_file)
        for batch in batches:
            for part, block in blocks(batch):
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(np.array(count(block), np.int64))], ["digest", "n_tokens"])

    return run


def stored(spark, cache: str, version: str) -> DataFrame:
    """The counts that the cache holds for one tokenizer, one row per digest."""
    try:
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException:
        known = spark.createDataFrame([], CACHE_SCHEMA)
    return known.where(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, model_file: str, cache: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row; new counts are added to ``cache``."""
    spark, version = docs.sparkSession, tokenizer_version(model_file)
    source = texts(docs, "doc_id").withColumn("digest", F.sha2("text", 256))
    lean = cut_lineage(source.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")))
    wanted = lean.select("digest").distinct()
    misses = cut_lineage(wanted.join(stored(spark, cache, version), "digest", "left_anti"))
    distinct = source.groupBy("digest").agg(F.first("text").alias("text")).join(misses, "digest", "left_semi")
    fresh = map_batches(distinct, _count_tokens(model_file), "digest string, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return lean.join(stored(spark, cache, version), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def fresh_cache(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
