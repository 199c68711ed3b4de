"""Work that must not be repeated, so that it grows no faster than the input."""

import random
import re

import pandas as pd
from pyspark.sql import functions as F

from isolark import session
from isolark.functions import quality as Q, taxonomy as T
from isolark.operators import assembly, bitplanes, collection, reads as R, reporting, selection, trees
from isolark.streaming import live


def test_prepared_reads_walk_over_the_bases_a_few_times(spark):
    rows = spark.range(1).select(
        F.lit("r").alias("read_id"), F.lit("i").alias("sequence_id"), F.lit("forward").alias("direction"), F.lit("27F").alias("primer"), F.concat(F.lit("fastq"), F.col("id").cast("string")).alias("quality_source"),
        F.lit(1.0).alias("mixed_peak_percent"), F.concat(F.lit("ACGTN"), F.col("id").cast("string")).alias("sequence"), F.array(F.col("id").cast("int")).alias("qualities"),
    )
    prepared = R.prepare_reads(rows)
    for out in (prepared, R.failed_reads(prepared), R.failure_manifest(prepared)):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("aggregate(") <= 12
    trimmed = rows.select(F.when(F.col("quality_source") != "none", Q.mott_trim("sequence", "qualities")))
    assert trimmed._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") <= 2


def test_pairs_aligned_together_are_aligned_as_alone():
    pairs = [("", "ACGT"), ("ACGTNACGTAAC", "TACGTAACGGGT"), ("A", ""), ("GGGGACGTACGTTTGACCA", "ACGTACGTTGACCATT"), ("AAAA", "AAAA"), ("ACGT" * 40, "GT" + "ACGT" * 30)]
    alone = [assembly.align(*p) for p in pairs]
    for cells in (1, 1 << 12, 1 << 22):
        assembly.CELLS = cells
        assert [[tuple(x) for x in places.tolist()] for places in assembly.align_many(pairs)] == alone
    for (a, b), places in zip(pairs, alone, strict=True):
        assert [i for i, _ in places if i >= 0] == list(range(len(a))) and [j for _, j in places if j >= 0] == list(range(len(b)))
        paired = [(a[i], b[j]) for i, j in places if i >= 0 and j >= 0]
        assert len(paired) >= min(len(a), len(b)) // 2


def test_settled_short_ids_are_never_gathered_by_the_driver(spark, monkeypatch):
    cut, plans = session.cut_lineage, []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(session, "cut_lineage", seen)
    ids = collection.short_ids(spark.range(3000).select(F.col("id").alias("seq_no"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("header")))
    assert ids.select("short_id").distinct().count() == 3000
    assert len(plans) > 3 and not any("Broadcast" in p for p in plans)


def test_a_lineage_is_split_once(spark):
    rows = spark.createDataFrame([("d__A;g__x;g__ 'y  z' ;s__",), (None,), ("",)], "t string").select(T.lineage_map("t").alias("m"))
    assert [r.m for r in rows.collect()] == [{"d": "A", "g": "y z"}, {}, {}]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_a_pair_is_compared_once(spark):
    rows = spark.createDataFrame([("ACGT-N", "ACCTAA"), ("--", "AC"), (None, "A")], "a string, b string").select(reporting.msa_identity("a", "b").alias("m")).select("m.identity", "m.compared")
    assert [tuple(r) for r in rows.collect()][:2] == [(75.0, 4), (None, 0)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("zip_with(") == 1


def test_isolates_of_a_shard_are_told_in_one_call():
    class State:
        exists, get, wake = False, None, None

        def getCurrentWatermarkMs(self):
            return self.reached

        def update(self, value):
            self.exists, self.get = True, value

        def setTimeoutTimestamp(self, at):
            self.wake = at

    state = State()
    rows = pd.DataFrame({"id": [f"i{k % 500}" for k in range(1000)], "at": [1000 - k // 500 for k in range(1000)], "line": range(1000), "status": ["A" if k < 500 else "B" for k in range(1000)], "detail": ""})
    state.reached = 0
    assert list(live._transitions(None, (7,), iter([rows]), state)) == [] and state.wake == 999
    state.reached = 999
    [early] = live._transitions(None, (7,), iter([]), state)
    state.reached = 5000
    [late] = live._transitions(None, (7,), iter([]), state)
    assert len(early) == len(late) == 500 and set(early["status"]) == {"B"} and early["old_status"].isna().all()
    assert set(late["old_status"]) == {"B"} and set(late["status"]) == {"A"} and set(late["id"]) == set(early["id"])


def test_picks_walk_over_what_can_be_picked(spark):
    """Few parents with many leaves: what is left doesn't grow with the leaves, and the picks are those of the plain loop."""
    rng = random.Random(5)
    nodes = [("root", None, 0.0, False), *((f"v{i}", "root", (i + 1) / 4, False) for i in range(3))]
    rows = []
    for k in range(240):
        nodes.append((f"L{k:03}", f"v{k % 3}", rng.randint(1, 4) / 8, True))
        rows.append((f"g{k % 2}", f"i{k:03}", rng.choice([f"L{k:03}", f"L{k - k % 5:03}", "none"]), rng.randint(0, 3)))
    anchors = [("g0", "L000"), ("g0", "L007"), ("g0", "L030")]
    above = {n: (p, b) for n, p, b, _ in nodes}
    far = lambda a, b: 0.0 if a == b else above[a][1] + above[b][1] + (above[above[a][0]][1] + above[above[b][0]][1] if above[a][0] != above[b][0] else 0.0)
    closed = trees.closure(spark.createDataFrame(nodes, "node_id string, parent_id string, branch_length double, is_leaf boolean"))
    held = spark.createDataFrame(rows, "grp string, id string, leaf string, e int").select("grp", "id", "leaf", F.struct("e", "id").alias("evidence"))
    marks = spark.createDataFrame(anchors, "grp string, leaf string")
    assert selection.contenders(held, marks, closed, 4, True).count() < 120
    want = []
    for g in ("g0", "g1"):
        chosen, left = [leaf for h, leaf in anchors if h == g], [r for r in rows if r[0] == g]
        for rank in range(1, 5):
            near = lambda r: min((far(r[2], c) for c in chosen), default=None) if r[2] != "none" else None  # noqa: B023, E731
            best = max(left, key=lambda r: (near(r) is not None, near(r) or 0.0, r[3], r[1]))
            want.append((g, best[1], rank, near(best)))
            left.remove(best)
            chosen += [best[2]] if best[2] != "none" else []
    got = selection.diversity_panel(held, marks, closed, 4).collect()
    assert sorted((r.grp, r.id, r["rank"], r.spread) for r in got) == sorted(want)


def test_blocks_of_one_group_are_compared_by_many_tasks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"i{k:03}", "".join(rng.choice("ACGT-") for _ in range(40))) for k in range(90)]
    df = spark.createDataFrame(rows, "id string, aligned string").withColumn("grp", F.lit("one")).coalesce(1)
    whole = sorted(bitplanes.nearest_in_group(df, df, "grp").collect())
    monkeypatch.setattr(bitplanes, "SPAN", 2)
    many = df.repartition(18)  # a task makes its own blocks
    out = bitplanes.nearest_in_group(many, many, "grp")
    parts = re.findall(r"hashpartitioning\(grp#\d+, l_at#\d+L?, r_at#\d+L?, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
    assert {int(n) for n in parts} == {81} and sorted(out.collect()) == whole and len(whole) == 90
