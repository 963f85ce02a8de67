"""State from logs and snapshots: latest rows, stages, quotas, supersession."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each group by `order` (its last column makes it total); one shuffle with partial aggregates."""
    best = F.max_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def furthest_stage(stages: list[tuple[str, Column]], none: str) -> Column:
    """The last of the stages that has been reached."""
    out = F.lit(none)
    for name, reached in stages:
        out = F.when(reached, F.lit(name)).otherwise(out)
    return out


def cancelled_failures(df: DataFrame, keys: list[str], time: str, failed: Column, done: Column) -> DataFrame:
    """Failures, each with whether a later success of its group cancels it."""
    last = df.where(done).groupBy(*keys).agg(F.max(time).alias("_done"))
    return df.where(failed).join(last, keys, "left").withColumn("cancelled", F.coalesce(F.col("_done") > F.col(time), F.lit(False))).drop("_done")


def within_quota(df: DataFrame, keys: list[str], time: str, span: str, limit: int, order: list[str]) -> DataFrame:
    """Adds `used`, the number within the group and tumbling span so far, and `allowed`."""
    window = Window.partitionBy(*keys, F.date_trunc(span, time)).orderBy(*order)
    return df.withColumn("used", F.row_number().over(window)).withColumn("allowed", F.col("used") <= limit)


def idle_sessions(df: DataFrame, keys: list[str], time: str, idle_s: float, order: list[str]) -> DataFrame:
    """Adds `gap_s` since the group's row before and `session`, which rises where the gap is longer than `idle_s`."""
    window = Window.partitionBy(*keys).orderBy(time, *order)
    stamp = F.col(time).cast("timestamp")
    gap = (F.unix_micros(stamp) - F.lag(F.unix_micros(stamp)).over(window)) / 1e6
    return df.withColumn("gap_s", gap).withColumn("session", F.sum(F.coalesce((F.col("gap_s") > idle_s).cast("int"), F.lit(0))).over(window) + 1)


def superseded(df: DataFrame, parts: DataFrame, key: str, whole: Column, halves: tuple[Column, Column]) -> DataFrame:
    """The rows of `df` that no replacement covers: a whole one, or both halves, hide a row."""
    covered = parts.groupBy(key).agg(F.bool_or(F.coalesce(whole, F.lit(False))).alias("w"), *(F.bool_or(F.coalesce(h, F.lit(False))).alias(f"h{k}") for k, h in enumerate(halves)))
    return df.join(covered.where("w OR (h0 AND h1)").select(key), key, "left_anti")


def changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Snapshot difference: added, removed and changed keys; nulls compare as values."""
    a = old.select(F.col(key), F.struct(*columns).alias("_old"), F.lit(True).alias("_in_old"))
    b = new.select(F.col(key), F.struct(*columns).alias("_new"), F.lit(True).alias("_in_new"))
    both = a.join(b, key, "full")
    kind = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return both.select(key, kind.alias("change")).where("change IS NOT NULL")


JOB_TRANSITIONS = {"queued": ("running",), "running": ("done", "error", "queued"), "error": ("queued",), "done": ()}


def claim_order(df: DataFrame, as_of: str, stale_hours: int = 3, attempts: int = 3) -> DataFrame:
    """Jobs that may be claimed, in order: queued ones first, then running ones that went stale.

    Needs status, priority, created_at, started_at, attempts and id.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    stale = (F.col("status") == "running") & (F.col("started_at") < now - F.expr(f"interval {stale_hours} hours"))
    ready = df.where(((F.col("status") == "queued") | stale) & (F.col("attempts") < attempts))
    return ready.orderBy(F.col("status") != "queued", F.desc("priority"), "created_at", "id")
