"""File readers, state changes and small rule expectations."""

import gzip
import struct

import pytest
from pyspark.sql import functions as F

from isolark.functions import quality as Q, scores, taxonomy as T
from isolark.operators import hits as H, reporting as R, state as S, targets
from isolark.sources import files, sinks


def abif(calls: bytes, quals: bytes, peaks, dyes, order=b"GATC"):
    items = [(b"PBAS", 2, 2, 1, calls), (b"PCON", 2, 2, 1, quals), (b"FWO_", 1, 2, 1, order), (b"PLOC", 2, 4, 2, struct.pack(f">{len(peaks)}h", *peaks))]
    items += [(b"DATA", 9 + i, 4, 2, struct.pack(f">{len(d)}h", *d)) for i, d in enumerate(dyes)]
    body, entries = b"", []
    for name, number, kind, width, raw in items:
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(">i", 128 + len(body))
        if len(raw) > 4:
            body += raw
        entries.append(struct.pack(">4sihhii", name, number, kind, width, len(raw) // width, len(raw)) + where + b"\0\0\0\0")
    head = b"ABIF" + struct.pack(">h", 101) + struct.pack(">4sihhiiii", b"tdir", 1, 1023, 28, len(entries), 28 * len(entries), 128 + len(body), 0)
    return head.ljust(128, b"\0") + body + b"".join(entries)


def test_traces(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "iso_27F.ab1").write_bytes(abif(b"ACGTX", bytes([30, 20, 40, 10, 5]), [1, 2, 3, 4, 5], [[9, 8, 7, 6, 5, 4]] * 4))
    (tmp_path / "bad.ab1").write_bytes(b"nope")
    got = {r["read_id"]: r for r in files.read_traces(spark, str(tmp_path)).collect()}
    ok = got["iso_27F"]
    assert (ok["sequence"], ok["qualities"], ok["peaks"], ok["quality_available"]) == ("ACGTN", [30, 20, 40, 10, 5], [1, 2, 3, 4, 5], True)
    assert ok["a"] == [9, 8, 7, 6, 5, 4] and got["bad"]["error"]


def test_fasta_fastq_newick_hits(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">one lineage\nACGT\nAC\n>two\nGG\n>\nTT\n")
    with gzip.open(tmp_path / "b.fasta.gz", "wt") as f:
        f.write(">three\nAA\n")
    rows = {r[0]: r[1] for r in files.read_fasta(spark, str(tmp_path / "*.fasta*")).collect()}
    assert rows == {"one lineage": "ACGTAC", "two": "GG", "three": "AA"}
    (tmp_path / "r.fastq").write_text("@r1\nacgt\n+\n@I#\n@r2\nGG\n+x\nII\n")
    reads = {r[0]: (r[1], r[2]) for r in files.read_fastq(spark, str(tmp_path / "r.fastq")).collect()}
    assert reads == {"r1": ("ACGT", [31, 40, 2, 0]), "r2": ("GG", [40, 40])}
    (tmp_path / "bad.fastq").write_text("r1\nAC\n+\nII\n")
    with pytest.raises(Exception, match="malformed"):
        files.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()
    (tmp_path / "t.nwk").write_text("((Q1:0.01,'Q 2':0.02)x:0.5,(Q3:bad,(Q4:0.04,Q5):0.01));")
    nodes = files.read_newick(spark, str(tmp_path / "t.nwk")).collect()
    assert {r["name"]: r["branch_length"] for r in nodes if r["is_leaf"]} == {"Q1": 0.01, "Q 2": 0.02, "Q3": 0.0, "Q4": 0.04, "Q5": 0.0}
    names = {r["node_id"]: r for r in nodes}
    q4 = next(r for r in nodes if r["name"] == "Q4")
    assert names[names[q4["parent_id"]]["parent_id"]]["is_leaf"] is False and sum(r["parent_id"] is None for r in nodes) == 1
    (tmp_path / "h.tsv").write_text("q\tt\t99.2\nq\tu\tbad\nq\tv\n")
    assert files.read_hits(spark, str(tmp_path / "h.tsv")).count() == 1


def test_ledger_and_targets_and_reports(spark, tmp_path):
    (tmp_path / "l.csv").write_text("﻿Isolate ID,Partner,Already-Sequenced,Host\nA1, p1 ,yes,cow\n,,,\n")
    row = files.read_ledger(spark, str(tmp_path / "l.csv")).collect()
    assert [(r["sequence_id"], r["partner_id"], r["already_sequenced"], r["host"]) for r in row] == [("A1", "p1", "yes", "cow")]
    (tmp_path / "t.tsv").write_text("Target ID\tHierarchy\tRole\nW1\tp__X; g__Y (including Zed)\tcore\n")
    terms = targets.target_terms(files.read_target_list(spark, str(tmp_path / "t.tsv")))
    assert {(r["rank"], r["name"]) for r in terms.collect()} == {("p", "x"), ("g", "y"), ("*", "zed")}
    df = spark.createDataFrame([("a", None, ["x", "y"])], "id string, v double, l array<string>")
    sinks.write_report(df.coalesce(1), str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert text.splitlines() == ["id\tv\tl", "a\tNA\tx;y"]
    inv = files.inventory(spark, str(tmp_path / "out"), "part*")
    assert files.directory_digest(inv).collect()[0]["files"] == inv.count()


def test_density_and_target_expectations(spark):
    hits = spark.createDataFrame([("q", f"t{i}", i, v, 500, 90.0) for i, v in enumerate((99.2, 97.4, 95.1))], "query string, target string, ordinal int, identity double, alnlen int, query_coverage double")
    got = H.metrics(spark.createDataFrame([("q",), ("z",)], "query string"), hits).collect()
    by = {r["query"]: r for r in got}
    assert (by["q"]["matches_ge_99"], by["q"]["matches_ge_97"], by["q"]["matches_ge_95"], by["q"]["novel"]) == (1, 2, 3, False)
    assert (by["z"]["nearest_hit"], by["z"]["nearest_identity"], by["z"]["novelty_score"]) == (None, 0.0, 100.0)
    terms = spark.createDataFrame([("W", "", "g", "prevotella")], "target_id string, target_role string, rank string, name string")
    rows = spark.createDataFrame([("i", "d__Bacteria;g__Prevotella", 99.0)], "id string, taxonomy string, identity double")
    best = targets.match_targets(rows, terms).collect()[0]
    assert best["target_score"] == 89.10
    got = rows.select(targets.evaluation_score(F.lit(80.0), F.lit(89.10), F.lit(None).cast("double"))).collect()[0][0]
    assert got == 82.28


def test_small_rules(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c).collect()[0][0]
    assert ask(T.domain_matches(F.lit("p__Bacteria_like"), "bacteria")) is False
    assert ask(T.lineage_map(F.lit("domain__Bacteria; g__A ;g__B;s__"))) == {"d": "Bacteria", "g": "B"}
    assert ask(R.msa_identity(F.lit("ACGT--N"), F.lit("ACG---A"))) == (100.0, 3)
    assert ask(Q.processing_mode(F.lit("please merge; thanks"))) == "assemble"
    assert ask(Q.primer_end(F.lit("GGAGAGTTTGATCATGGCTCAGTTTT"), F.lit("27F"))) == 22
    assert ask(scores.evidence_quality(F.lit("CHIMERA"), F.lit(99.0), F.lit(1.0), F.lit(99.0), F.lit("d__X"))) == "LOW"
    with pytest.raises(ValueError):
        Q.ReadPolicy(warn_n_percent=9.0)


def test_upsert_and_removals(spark):
    seqs = spark.createDataFrame([("a", "AC"), ("b", "GG")], "id string, sequence string")
    more = spark.createDataFrame([("a", "TT"), ("c", "AA")], "id string, sequence string")
    assert {tuple(r) for r in S.upsert(seqs, more, "sequences").collect()} == {("a", "AC"), ("b", "GG"), ("c", "AA")}
    old = spark.createDataFrame([("a", "p1", True)], "id string, partner_id string, status_kept boolean")
    new = spark.createDataFrame([("a", "p2", False)], "id string, partner_id string, status_kept boolean")
    assert [tuple(r) for r in S.upsert(old, new, "sequencing_metadata", ["status_kept"]).collect()] == [("a", "p2", True)]
    plan = spark.createDataFrame([("a", "READY")], "requested_id string, status string")
    pruned, tombs = S.apply_removals({"sequences": (seqs, "id")}, plan)
    assert [r["id"] for r in pruned["sequences"].collect()] == ["b"] and tombs.collect()[0]["deleted"] == '{"sequences":1}'
    with pytest.raises(ValueError):
        S.apply_removals({"sequences": (seqs, "id")}, spark.createDataFrame([("a", "NOT_FOUND")], "requested_id string, status string"))


def test_results_do_not_depend_on_partitions(spark):
    import __spark_entry__ as entry

    before = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.append(sorted(map(str, entry.queries()["sequencing_sets"](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1]


def test_large_files_are_hashed_in_chunks(spark, tmp_path, monkeypatch):
    import hashlib

    monkeypatch.setattr(files, "CHUNK", 1000)
    want = {}
    for k, size in enumerate((0, 1, 999, 1000, 12_345)):
        data = bytes((i * (k + 3)) % 251 for i in range(size))
        (tmp_path / f"f {k}.bin").write_bytes(data)
        if size:
            want[f"f {k}.bin"] = (size, hashlib.sha256(data).hexdigest())
    got = {r["path"].replace("%20", " ").rsplit("/", 1)[1]: (r["size"], r["sha256"]) for r in files.inventory(spark, str(tmp_path)).collect()}
    assert got == want


def test_directory_digest_is_a_tree_over_path_hashes(spark):
    import hashlib

    hexed = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def plain(rows):
        depth = 0
        while files.LEAF * 16**depth < len(rows):
            depth += 1
        groups = {}
        for path, _, sha in rows:
            groups.setdefault(hexed(path)[:depth], []).append(f"{path}:{sha}")
        level = {k: hexed("\n".join(sorted(v))) for k, v in groups.items()}
        for size in range(depth - 1, -1, -1):
            above = {}
            for k, v in level.items():
                above.setdefault(k[:size], []).append(f"{k}:{v}")
            level = {k: hexed("\n".join(sorted(v))) for k, v in above.items()}
        return (len(rows), sum(r[1] for r in rows), level.get(""))

    for n in (0, 1, 64, 65, 1500):
        rows = [(f"file:/x/{i}", i, hexed(str(i))) for i in range(n)]
        got = files.directory_digest(spark.createDataFrame(rows, "path string, size long, sha256 string").repartition(7)).collect()
        assert [tuple(r) for r in got] == [plain(rows)]
