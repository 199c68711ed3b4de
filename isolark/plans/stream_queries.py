"""Registered streaming queries, each over a whole given table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from isolark.plans.bindings import table, view
from isolark.registry import query
from isolark.session import shared_folder
from isolark.streaming import live


def _folder(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    """The table as a stream, be it one file or a folder of part files."""
    schema = table(spark, sf, name).schema
    # A pattern, since a stream takes a single file only from one.
    return spark.readStream.schema(schema).parquet(f"{sf}/{name}.parque[t]")


@query("status_windows", "SELECT date_trunc('day', ts)::timestamp AS window_start, event_type, count(*) AS n FROM {events} GROUP BY 1, 2")
def status_windows(spark, sf):
    counts = live.windowed_counts(_stream(spark, sf, "events"))
    out = live.drain(counts, _folder(spark), mode="complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "sliding_windows",
    """
SELECT cast(h - k * interval 6 hour AS timestamp) AS window_start, event_type, count(*) AS n
FROM (SELECT time_bucket(interval 6 hour, ts) AS h, event_type FROM {events}) e, (SELECT unnest([0, 1, 2, 3]) AS k) s GROUP BY 1, 2""",
)
def sliding_windows(spark, sf):
    counts = live.windowed_counts(_stream(spark, sf, "events"), slide="6 hours")
    out = live.drain(counts, _folder(spark), mode="complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "session_windows",
    """
WITH e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM {events}),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before > interval 6 hour THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS visit FROM e)
SELECT cast(min(ts) AS timestamp) AS session_start, user_id, count(*) AS n FROM s GROUP BY user_id, visit""",
)
def session_windows(spark, sf):
    counts = live.session_counts(_stream(spark, sf, "events"), gap="6 hours")
    out = live.drain(counts, _folder(spark), mode="complete")
    return out.select(F.col("session_start").cast("timestamp_ntz").alias("session_start"), "user_id", "n")


@query("stream_submissions", "SELECT count(DISTINCT md5(text)) AS sequences FROM {documents}")
def stream_submissions(spark, sf):
    stream = _stream(spark, sf, "documents").select(F.col("doc_id"), F.col("text").alias("sequence"), F.lit("2024-01-01").cast("timestamp").alias("ts"))
    kept = live.drain(live.first_submissions(stream).select("doc_id", "digest"), _folder(spark))
    return kept.agg(F.count("digest").alias("sequences"))  # a null text has no digest


@query(
    "stream_enrichment",
    "SELECT e.event_id, e.event_type, c.c_mktsegment FROM {events} e LEFT JOIN {customer} c ON c.c_custkey = e.user_id",
)
def stream_enrichment(spark, sf):
    ledger = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    stream = _stream(spark, sf, "events").select("event_id", "event_type", "user_id")
    return live.drain(live.enrich(stream, ledger, "user_id").select("event_id", "event_type", "c_mktsegment"), _folder(spark))


@query(
    "stream_transitions",
    """
WITH ok AS (SELECT *, CASE lower(word) WHEN 'received' THEN 'RECEIVED' WHEN 'trace-review' THEN 'TRACE_REVIEW' WHEN 'approved' THEN 'SAB_APPROVED' WHEN 'dna pending' THEN 'DNA_EXTRACTION_PENDING'
   WHEN 'proposed' THEN 'PROPOSED' WHEN 'qc_passed' THEN 'GENOME_QC_PASSED' END AS status FROM {status_updates}),
e AS (SELECT id, line, status, detail, lag(status) OVER (PARTITION BY id ORDER BY ts, line) AS old_status FROM ok WHERE status IS NOT NULL)
SELECT id, line, old_status, status, detail FROM e WHERE old_status IS DISTINCT FROM status OR detail <> ''""",
)
def stream_transitions(spark, sf):
    folder = _folder(spark)
    updates = view(spark, sf, "status_updates")
    updates.write.parquet(f"{folder}/in")
    # A last update far ahead moves the watermark past all others.
    closing = updates.limit(1).withColumns({"id": F.lit("~"), "ts": F.lit("2200-01-01").cast(updates.schema["ts"].dataType), "word": F.lit("received")})
    closing.write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(updates.schema).parquet(f"{folder}/in")
    return live.drain(live.status_transitions(stream), folder).filter("id <> '~'")
