"""Continuous twins of the batch ledger operators."""

from __future__ import annotations

from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from isolark.functions.identifiers import state_name


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts per event-time window and type; rows later than the watermark are left out."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = timed.groupBy(window.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "n")


def session_counts(events: DataFrame, late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("session_start"), "user_id", "n")


def first_submissions(submissions: DataFrame, late: str = "7 days") -> DataFrame:
    """Drops re-submitted sequences seen again within the watermark."""
    timed = submissions.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.withColumn("digest", F.md5("sequence")).dropDuplicatesWithinWatermark(["digest"])


def enrich(stream: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Stream rows with their ledger row; Spark picks the join by the measured ledger size."""
    return stream.join(ledger, key, "left")


_EVENT = "id string, line long, old_status string, status string, detail string"
_KEPT = ["id", "at", "line", "status", "detail", "told"]


def _transitions(forget: int | None, _key, parts, state):
    """Updates of one shard of isolates, held until the watermark has passed them and then told in order of time and line.

    The state is one table that travels with the rows of a batch: the updates that
    are still ahead of the watermark, and of each isolate the last one that was
    told. The one timer is for the earliest held update or, with ``forget``, for
    when the first silent isolate's last status is dropped.
    """
    before = [pa.ipc.open_stream(state.get[0]).read_pandas()] if state.exists else []
    rows = pd.concat([*before, *(p.assign(told=False)[_KEPT] for p in parts)], ignore_index=True)
    rows = rows.sort_values(["id", "told", "at", "line"], ascending=[True, False, True, True], ignore_index=True)
    reached = state.getCurrentWatermarkMs()
    held = ~rows["told"] & (rows["at"] > reached)
    ready, ahead = rows[~held], rows[held]
    known = ready["id"] == ready["id"].shift()
    if forget is not None:
        known &= ready["at"] - ready["at"].shift() <= forget
    old = ready["status"].shift().where(known, None)
    out = ready.assign(old_status=old)[~ready["told"] & ((ready["status"] != old) | (ready["detail"] != ""))]
    last = ready.drop_duplicates("id", keep="last").assign(told=True, detail="")
    wake = [ahead["at"].min()] if len(ahead) else []
    if forget is not None:
        silent = ~last["id"].isin(ahead["id"])
        last = last[~silent | (last["at"] + forget > reached)]
        wake += (last["at"][silent] + forget).tolist()
    kept = pd.concat([last, ahead])
    if len(kept):
        table, packed = pa.Table.from_pandas(kept, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(packed, table.schema) as writer:
            writer.write_table(table)
        state.update((packed.getvalue().to_pybytes(),))
        if wake:
            state.setTimeoutTimestamp(int(min(wake)))
    else:
        state.remove()
    if len(out):
        yield out[[c.split()[0] for c in _EVENT.split(", ")]]


def status_transitions(updates: DataFrame, late: str = "1 hour", forget_days: int | None = None, shards: int = 2048) -> DataFrame:
    """Transition events from a stream of raw status words, in event-time order however the updates arrive.

    Updates later than the watermark are left out. An isolate that has been silent
    for ``forget_days`` starts anew, so that state shrinks; without it the last
    status of every isolate stays. State is kept by ``shards``, each a hash's share of the
    isolates: a call per isolate would cost more than what it does.
    """
    ts = F.col("ts").cast("timestamp")
    parsed = updates.select("id", "line", ts.alias("ts"), F.unix_millis(ts).alias("at"), state_name("word").alias("status"), F.coalesce("detail", F.lit("")).alias("detail"))
    timed = parsed.withWatermark("ts", late).filter("status is not null AND id is not null")
    told = partial(_transitions, None if forget_days is None else forget_days * 86_400_000)
    sharded = timed.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return sharded.groupBy("shard").applyInPandasWithState(told, _EVENT, "kept binary", "append", GroupStateTimeout.EventTimeTimeout)


STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything that is available now and return what it wrote."""
    spark = stream.sparkSession
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)  # read when a query starts
    try:
        return _drained(spark, stream, folder, mode)
    finally:
        spark.conf.set(STATE_STORE[0], before)


def _drained(spark, stream: DataFrame, folder: str, mode: str) -> DataFrame:
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    else:
        # The whole result table is rewritten by each batch; only the last version is kept.
        def replace(batch: DataFrame, _epoch: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/out")

        query = stream.writeStream.foreachBatch(replace).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
