"""Reads of texts go through the whole read preparation, and overlaps are the best ones."""

import random

import duckdb
import pytest

from isolark.operators import assembly


def best_score(a, b):
    """Score of the best alignment with free ends, cell by cell."""
    never = -(10**6)
    best, down = [0] * (len(b) + 1), [never] * (len(b) + 1)
    ends = [0]
    for x in a:
        now, side = [0], never
        for j, y in enumerate(b, 1):
            down[j] = max(best[j] - 6, down[j] - 1)
            side = max(now[-1] - 6, side - 1)
            now.append(max(best[j - 1] + (0 if "N" in (x, y) else 2 if x == y else -3), down[j], side))
        best = now
        ends.append(best[-1])
    return max(*best, *ends)


def score(a, b, places):
    both = [k for k, (i, j) in enumerate(places) if i >= 0 and j >= 0]
    total, gap = 0, None
    for i, j in places[both[0] : both[-1] + 1].tolist() if both else []:
        if i >= 0 and j >= 0:
            total, gap = total + (0 if "N" in (a[i], b[j]) else 2 if a[i] == b[j] else -3), None
        else:
            total, gap = total - (1 if gap == (i < 0) else 6), i < 0
    return total


def test_alignments_are_the_best_ones():
    rng = random.Random(4)
    pairs = []
    for _ in range(60):
        root = "".join(rng.choice("ACGTN") for _ in range(rng.randint(1, 90)))
        at = rng.randrange(len(root))
        pairs.append((root, root[:at] + "".join(rng.choice("ACGT") for _ in range(rng.randint(0, 7))) + root[at + rng.randint(0, 9) :] + "TTA"))
        pairs.append((root[at:], root)[:: rng.choice([1, -1])])
    places = assembly.align_many(pairs)
    assert [score(*p, x) for p, x in zip(pairs, places, strict=True)] == [best_score(*p) for p in pairs]
    # What lies inside the other text as it is needs no table, and gets what the table would give.
    assert all((x == assembly._aligned([p])[0]).all() for p, x in zip(pairs, places, strict=True))
    assert sum(assembly._contained(*p) is not None for p in pairs) > 10


@pytest.fixture(scope="module")
def turns(tmp_path_factory):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(rng.randint(4, 9))) for _ in range(400)]
    out = tmp_path_factory.mktemp("turns")
    rows = ", ".join(f"({c}, {t}, '{'user' if t % 2 else 'assistant'}', '{' '.join(rng.choice(words) for _ in range(n))}')" for c, t, n in ((1, 0, 50), (1, 1, 40), (40, 3, 60), (2, 2, 2)))
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) x(conv_id, turn, role, text)) TO '{out}/conversations.parquet' (FORMAT parquet)")
    return str(out)


def test_fragments_are_prepared_oriented_and_extended(spark, turns):
    from isolark.plans import read_queries

    reads = {r["read_id"]: r for r in read_queries._fragments(spark, turns).collect()}
    assert len(reads) == 12 and {r["direction"] for r in reads.values()} == {"forward", "reverse"}
    kept = {k for k, r in reads.items() if r["kept"]}
    assert {k[:-1] for k in kept} == {"I1_0", "I1_1"}  # a mixed trace and a text below the least length fail
    for k in ("I1_0", "I1_1"):
        whole = reads[k + "w"]["oriented"]
        assert all(reads[k + p]["oriented"] in whole for p in "ab") and len(reads[k + "a"]["oriented"]) < 0.7 * len(whole)
    got = {r["sequence_id"]: r for r in read_queries.assemble_isolates(spark, turns).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"FI1_0": "assembled", "FI1_1": "assembled", "FI40_3": "failed_no_reads", "FI2_2": "failed_no_reads"}
    assert all(got[k]["unmerged"] == 0 and got[k]["length"] == len(reads[k[1:] + "w"]["oriented"]) for k in ("FI1_0", "FI1_1"))
    placed = read_queries.read_placements(spark, turns).collect()
    assert len(placed) == 12 and {r["read_id"] for r in placed if r["contributes"]} == kept
    pairs = {r["sequence_id"] for r in read_queries.overlap_pairs(spark, turns).collect()}
    assert pairs == {"FI1_0", "FI1_1"}


def test_every_isolate_that_fails_is_in_the_manifest(spark):
    from isolark.functions.quality import ReadPolicy
    from isolark.operators import reads as R

    rng = random.Random(7)
    root = "".join(rng.choice("ACGT") for _ in range(1200))
    rows = []

    def read(isolate, name, seq, quality=40, mode="", peak=0.0, direction="forward"):
        rows.append((isolate, name, direction, "unknown", mode, seq, [quality] * len(seq), "fastq", peak))

    read("short", "s1", root[:500]), read("short", "s2", root[300:700])  # assembled, 700 letters
    read("long", "l1", root[:700]), read("long", "l2", root[500:1200])  # assembled, 1200 letters: passes
    read("apart", "a1", root[:400]), read("apart", "a2", root[700:1150])
    read("best", "b1", root[:900], 30, "best read"), read("best", "b2", root[:500], 40, "best read")
    read("none", "n1", root[:600], 40, peak=40.0), read("none", "n2", root[:500] + "N" * 60 + root[500:560], 40, "assemble", 40.0, "reverse")
    schema = "sequence_id string, read_id string, direction string, primer string, mode_text string, sequence string, qualities array<int>, quality_source string, mixed_peak_percent double"
    prepared = R.prepare_reads(spark.createDataFrame(rows, schema))
    got = {r["sequence_id"]: r for r in R.failure_manifest(prepared).collect()}
    assert {k: (r["status"], r["reads"], r["kept_reads"], r["output_length"], r["best_recoverable"]) for k, r in got.items()} == {
        "short": ("filtered_output_length_lt_800", 2, 2, 700, "s1"),
        "apart": ("filtered_output_length_lt_800", 2, 2, 450, "a2"),
        "best": ("filtered_output_length_lt_800", 2, 2, 500, "b2"),
        "none": ("failed_no_reads", 2, 0, 0, "n2"),  # both of quality 40: the longer one
    }
    assert got["best"]["mode"] == "best_read" and got["best"]["selected_read"] == "b2" and got["short"]["selected_read"] is None
    assert got["short"]["reasons"] == "output_length_lt_800" and got["none"]["reasons"] == "no_output_sequence;failed_no_reads;failed_reads_2"
    assert got["apart"]["reasons"] == "output_length_lt_800;partial_no_overlap;unmerged_primer_reads_1" and {r["recommendation"] for r in got.values()} == {"RESEQUENCE"}
    strict = {r["sequence_id"] for r in R.failure_manifest(prepared, ReadPolicy(min_final_length=450)).collect()}
    assert strict == {"apart", "none"}
