"""Windowed counts, deduplication and job state over streams.

Each function takes a streaming DataFrame and gives one; batch DataFrames work
too, so a stream's result can be compared with the batch query of its name.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, files_at_once: int = 1) -> DataFrame:
    """Events of a folder's Parquet files; watermarks need a timestamp with zone, so `ts` becomes one."""
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_at_once).option("pathGlobFilter", "*.parquet").parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def quota_counts(events: DataFrame, span: str = "1 hour", late: str = "2 hours", limit: int = 2) -> DataFrame:
    """Events per user and tumbling window, and whether they are within the limit."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", span), "user_id").agg(F.count("*").alias("used"))
    return counts.select(F.col("window.start").alias("start"), "user_id", "used", (F.col("used") <= limit).alias("allowed"))


def sliding_counts(events: DataFrame, span: str = "1 hour", step: str = "15 minutes", late: str = "2 hours") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", span, step), "user_id").agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), "user_id", "n")


def sessions(events: DataFrame, gap: str = "4 hours", late: str = "2 hours") -> DataFrame:
    """Runs of a user's events without a longer gap."""
    found = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return found.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """One row for each key within the watermark: exactly-once intake of redelivered rows."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


_STATE = "status string, attempts int, at timestamp"
_OUT = "job long, status string, attempts int, at timestamp"


def _advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """queued -> running -> done or error; error -> queued; a running job without news for three hours is queued again."""
    (job,) = key
    allowed = {"queued": {"running"}, "running": {"done", "error"}, "error": {"queued"}, "done": set()}
    if state.hasTimedOut:
        status, attempts, at = state.get
        if status == "running":
            state.update(("queued", attempts, at))
            yield pd.DataFrame({"job": [job], "status": ["queued"], "attempts": [attempts], "at": [at]})
        return
    status, attempts, at = state.get if state.exists else ("queued", 0, None)
    for rows in batches:
        for r in rows.sort_values("ts").itertuples():
            if r.status in allowed[status]:
                attempts += r.status == "running"
                status, at = r.status, r.ts
    state.update((status, int(attempts), at))
    if status == "running":
        state.setTimeoutTimestamp(int(pd.Timestamp(at).timestamp() * 1000) + 3 * 3_600_000)
    yield pd.DataFrame({"job": [job], "status": [status], "attempts": [int(attempts)], "at": [at]})


def job_states(changes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Current state of each job from a stream of (job, status, ts); steps that aren't allowed are ignored."""
    return changes.withWatermark("ts", late).groupBy("job").applyInPandasWithState(_advance, _OUT, _STATE, "update", GroupStateTimeout.EventTimeTimeout)


class LastVerdict(StatefulProcessor):
    """The last verdict of an item and day; settled once no more can come, and forgotten then.

    The state is one row for each open item: rows are folded as they come, in any order, so
    neither a batch nor a key is held in memory.
    """

    def __init__(self, undo: str, undo_ms: int):
        self._undo, self._undo_ms = undo, undo_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "micros long, event long, verdict string, events long, undone long")

    def _row(self, key: tuple, last: tuple, settled: bool) -> Row:
        micros, event, verdict, events, undone = last
        return Row(item=key[0], day=key[1], verdict=None if verdict == self._undo else verdict, micros=micros, event=event, events=events, undone=undone, settled=settled)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = tuple(self._last.get()) if self._last.exists() else None
        opened = last is None
        for r in rows:
            micros, event, verdict, events, undone = last or (r.micros, r.event, r.verdict, 0, 0)
            if (r.micros, r.event) > (micros, event):
                micros, event, verdict = r.micros, r.event, r.verdict
            last = (micros, event, verdict, events + 1, undone + (r.verdict == self._undo))
        if last is None:
            return
        self._last.update(last)
        if opened:
            midnight = datetime(key[1].year, key[1].month, key[1].day, tzinfo=timezone.utc)
            self._handle.registerTimer(int(midnight.timestamp() * 1000) + 86_400_000 + self._undo_ms)
        yield self._row(key, last, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._last.exists():
            yield self._row(key, tuple(self._last.get()), True)
            self._last.clear()

    def close(self) -> None:
        pass


def last_verdicts(log: DataFrame, undo: str, undo_minutes: int = 30, late: str = "2 hours") -> DataFrame:
    """The last verdict of each item and day (UTC) from an append-only log (item, event, verdict, ts).

    By ts and event the last row wins; an undo is a row of its own and leaves no verdict (null; a null verdict counts as one). In update mode every
    batch gives its items' rows; a settled one, the last for its item and day, comes when the
    watermark is `undo_minutes` past the day. Rows later than `late` may be left out then. Rows without item or ts are
    left out. Needs the RocksDB state store, which `run_updates` sets.
    """
    rows = log.where("item IS NOT NULL AND ts IS NOT NULL AND event IS NOT NULL").withWatermark("ts", late)
    rows = rows.select("item", F.to_date(F.to_utc_timestamp("ts", F.current_timezone())).alias("day"), "event", F.coalesce("verdict", F.lit(undo)).alias("verdict"), F.unix_micros("ts").alias("micros"), "ts")
    item = rows.schema["item"].dataType.simpleString()
    out = f"item {item}, day date, verdict string, micros long, event long, events long, undone long, settled boolean"
    told = rows.groupBy("item", "day").transformWithState(LastVerdict(undo, undo_minutes * 60_000), out, "Update", "EventTime")
    return told.select("item", "day", "verdict", F.timestamp_micros("micros").alias("decided_at"), "event", "events", "undone", "settled")


def run_updates(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now in update mode, each batch's rows once in a folder `batch=N`; gives them with their batch."""

    def save(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    spark = stream.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(stream.schema.add("batch", "long")).option("basePath", path).parquet(f"{path}/batch=*")


def run_once(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, into a table in memory (for tests and small results)."""
    started = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Everything that is there now, appended to Parquet files exactly once."""
    started = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    started.awaitTermination()
    return stream.sparkSession.read.parquet(path)
