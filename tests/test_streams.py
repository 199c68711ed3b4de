"""The status stream against a plain replay, with small batches, several triggers, late and silent isolates."""

import random
from datetime import datetime, timedelta

from isolark.streaming import live

START = datetime(2024, 1, 1)
SCHEMA = "id string, line long, ts timestamp, word string, detail string"
STATES = {"received": "RECEIVED", "approved": "SAB_APPROVED", "proposed": "PROPOSED"}


def replay(rows, forget=None):
    """Transitions of rows (id, line, ts, word, detail) in order of time and line."""
    last, out = {}, []
    for i, line, ts, word, detail in sorted(rows, key=lambda r: (r[2], r[1])):
        if word not in STATES or i is None:
            continue
        before, at = last.get(i, (None, None))
        if forget is not None and at is not None and ts - at > forget:
            before = None
        if STATES[word] != before or detail:
            out.append((i, line, before, STATES[word], detail or ""))
        last[i] = STATES[word], ts
    return sorted(out, key=str)


def run(spark, tmp_path, triggers, **options):
    """The stream's events when each list of rows is one trigger's file."""
    schema = spark.createDataFrame([], SCHEMA).schema
    for k, rows in enumerate(triggers):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:03d}")
    key, rows_per_batch = "spark.sql.execution.arrow.maxRecordsPerBatch", "3"
    before, parts = spark.conf.get(key), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, rows_per_batch)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        found = live.drain(live.status_transitions(stream, **options), str(tmp_path)).collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return sorted(((r["id"], r["line"], r["old_status"], r["status"], r["detail"]) for r in found if r["id"] != "~"), key=str)


def closing(day):
    return ("~", 0, START + timedelta(days=day), "received", "")


def test_order_within_and_across_triggers(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"i{rng.randrange(4)}" if rng.random() < 0.95 else None, n, START + timedelta(minutes=rng.randrange(600)), rng.choice([*STATES, "lost"]), rng.choice(["", "", None, "note"])) for n in range(120)]
    # Rows come in any order, but never later than the watermark allows.
    shuffled = sorted(rows, key=lambda r: r[2] + timedelta(minutes=rng.randrange(90)))
    triggers = [shuffled[at : at + 40] for at in range(0, 120, 40)] + [[closing(30)], [closing(31)]]
    assert run(spark, tmp_path, triggers, late="2 hours") == replay(rows)


def test_late_rows_are_left_out_and_silent_isolates_forgotten(spark, tmp_path):
    day = lambda n: START + timedelta(days=n)
    first = [("a", 1, day(0), "received", ""), ("b", 2, day(0), "received", "")]
    second = [("a", 3, day(20), "received", ""), ("b", 4, day(5), "approved", "")]
    late = [("a", 5, day(1), "approved", ""), ("b", 6, day(40), "approved", "")]
    triggers = [first, second, [closing(30)], late, [closing(90)], [closing(91)]]
    got = run(spark, tmp_path, triggers, late="1 hour", forget_days=10)
    kept = [*first, *second[:1], ("b", 4, day(5), "approved", ""), late[1]]
    assert got == replay(kept, timedelta(days=10))
    assert ("a", 3, None, "RECEIVED", "") in got and ("b", 6, None, "SAB_APPROVED", "") in got and not any(line == 5 for _, line, *_ in got)
