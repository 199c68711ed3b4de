"""Blocks that meet blocks: shuffled, not broadcast, and in as many tasks as there is work for."""

import numpy as np
from pyspark.sql import functions as F

from isolark.llm import common, hard_negatives


def test_copies_for_all_buckets_are_not_broadcast(spark):
    blocks = spark.range(40).select(F.col("id").alias("block"), (F.col("id") % 2).cast("int").alias("dim"))
    sent = spark.range(6).select(F.col("id").alias("q"), (F.col("id") % 2).cast("int").alias("dim"))
    met = common.everywhere(blocks, sent, 40)
    assert sorted((r["block"], r["q"]) for r in met.collect()) == [(b, q) for b in range(40) for q in range(6) if b % 2 == q % 2]
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.rdd.getNumPartitions() == 8  # small-looking partitions of costly tiles stay apart
    assert common.everywhere(blocks.limit(0), sent, 0).count() == 0


def test_windows_of_ranked_rows_agree_with_best_columns():
    rng = np.random.default_rng(8)
    scores = rng.integers(-9, 9, (30, 21))
    scores[rng.random(scores.shape) < 0.3] = hard_negatives.NONE
    rows = rng.integers(0, 30, 50)
    least = rng.integers(-12, 12, 50)
    largest = least + rng.integers(-2, 9, 50)
    seen = scores[rows]
    i, j = hard_negatives.best_columns(np.where((seen >= least[:, None]) & (seen <= largest[:, None]), seen, hard_negatives.NONE), 3, 9)
    for bound in (9, 2**61):
        a, b = hard_negatives.Ranked(scores.copy(), 3, bound).between(rows, least, largest)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(i.tolist(), j.tolist()))
