"""Streaming queries over the events table, run to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.registry import Tables, query
from tessera.streaming import windows


def _folder(t: Tables, tag: str) -> str:
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return f"{base}/{tag}-{uuid.uuid4().hex}"


def _events(t: Tables) -> DataFrame:
    rows = t.spark.readStream.schema(windows.EVENTS).parquet(f"{t.sf_dir}/events.parquet*")
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT CAST(date_trunc('hour', ts) AS VARCHAR) AS start, user_id, count(*) AS used, count(*) <= 2 AS allowed FROM events GROUP BY 1, 2")
def q52_stream_quota(t: Tables) -> DataFrame:
    """Hourly quota by user from a stream in update mode; the watermark bounds the state, a window's last batch has its count."""
    told = windows.run_updates(windows.quota_counts(_events(t)), _folder(t, "stream-out"), _folder(t, "stream-state"))
    last = told.groupBy("start", "user_id").agg(F.max_by(F.struct("used", "allowed"), "batch").alias("r"))
    return last.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "user_id", "r.used", "r.allowed")


@query("SELECT event_id, user_id, event_type FROM events")
def q52b_stream_dedup(t: Tables) -> DataFrame:
    """Events delivered twice, taken in once."""
    events = _events(t)
    twice = events.select("event_id", "user_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("delivery"))
    once = windows.first_seen(twice, ["event_id"]).select("event_id", "user_id", "event_type")
    return windows.run_to_parquet(once, _folder(t, "stream-out"), _folder(t, "stream-state"))


@query("""
WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events WHERE user_id IS NOT NULL),
d AS (SELECT user_id, day, count(*) AS events, count(*) FILTER (event_type = 'error') AS undone, arg_max(event_type, (ts, event_id)) AS verdict, max((ts, event_id)) AS last FROM e GROUP BY 1, 2)
SELECT user_id, CAST(day AS VARCHAR) AS day, nullif(verdict, 'error') AS verdict, strftime(last[1], '%Y-%m-%d %H:%M:%S') AS decided_at, last[2] AS event_id, events, undone, day + INTERVAL '1 day 30 minutes' <= (SELECT max(ts) FROM e) - INTERVAL 2 HOUR AS settled FROM d
""")
def q128_stream_verdicts(t: Tables) -> DataFrame:
    """The last verdict of each user and day from a stream, an error undoing it, and whether it is settled."""
    log = _events(t).select(F.col("user_id").alias("item"), F.col("event_id").alias("event"), F.col("event_type").alias("verdict"), "ts")
    told = windows.run_updates(windows.last_verdicts(log, "error"), _folder(t, "stream-out"), _folder(t, "stream-state"))
    last = told.groupBy("item", "day").agg(F.max_by(F.struct("verdict", "decided_at", "event", "events", "undone", "settled"), F.struct("batch", "settled")).alias("r"))
    return last.select(
        F.col("item").alias("user_id"), F.col("day").cast("string").alias("day"), "r.verdict", F.date_format("r.decided_at", "yyyy-MM-dd HH:mm:ss").alias("decided_at"),
        F.col("r.event").alias("event_id"), "r.events", "r.undone", "r.settled",
    )
