"""Latest rows, stages, coverage, supersession, quotas, sessions and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import stats
from tessera.operators import rollup, state
from tessera.plans.registry import Tables, query


@query("""
SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice DESC, l_linenumber, l_suppkey, l_quantity, l_shipdate) = 1
""")
def q14_best_per_group(t: Tables) -> DataFrame:
    """The best row of each (order, part), ties broken by all columns."""
    w = Window.partitionBy("l_orderkey", "l_partkey").orderBy(F.desc("l_extendedprice"), "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate")
    return t.lineitem.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def q15_latest_per_group(t: Tables) -> DataFrame:
    """The last order of each customer, by partial aggregates instead of a sort."""
    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return state.latest(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("""
SELECT user_id, CASE WHEN bool_or(event_type = 'purchase' AND value > 200) THEN 'customer' WHEN bool_or(event_type = 'purchase') THEN 'buyer' WHEN bool_or(event_type = 'signup') THEN 'member' WHEN bool_or(event_type = 'view') THEN 'visitor' ELSE 'unknown' END AS stage,
  count(*) AS n FROM events GROUP BY user_id
""")
def q16_stage_derivation(t: Tables) -> DataFrame:
    """Each user's furthest stage."""
    flags = {"view": F.col("event_type") == "view", "signup": F.col("event_type") == "signup", "buy": F.col("event_type") == "purchase", "large": (F.col("event_type") == "purchase") & (F.col("value") > 200)}
    users = t.events.groupBy("user_id").agg(*(F.bool_or(test).alias(name) for name, test in flags.items()), F.count("*").alias("n"))
    stage = state.furthest_stage([("visitor", F.col("view")), ("member", F.col("signup")), ("buyer", F.col("buy")), ("customer", F.col("large"))], "unknown")
    return users.select("user_id", stage.alias("stage"), "n")


@query("""
SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT c_custkey) AS customers, count(DISTINCT c_custkey) FILTER (WHERE n_large > 0) AS with_large, count(DISTINCT c_custkey) FILTER (WHERE n_large IS NULL) AS without_large
FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n_large FROM orders WHERE o_totalprice > 400000 GROUP BY 1) ON o_custkey = c_custkey GROUP BY r_name
""")
def q17_filtered_distinct_coverage(t: Tables) -> DataFrame:
    """Coverage by region: distinct customers with and without a large order."""
    large = t.orders.where("o_totalprice > 400000").groupBy("o_custkey").agg(F.count("*").alias("n_large"))
    places = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"))
    rows = places.join(t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    counts = rollup.distinct_where({"nations": (F.lit(True), "n_nationkey"), "customers": (F.lit(True), "c_custkey"), "with_large": (F.col("n_large") > 0, "c_custkey"), "without_large": (F.col("n_large").isNull(), "c_custkey")})
    return rows.groupBy("r_name").agg(*counts)


_COVERAGE = """
SELECT n_nationkey, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) AS held,
  EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9900) AS rich,
  EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 5000) AS supplied,
  (SELECT c_custkey FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 1) AS preferred FROM nation
"""


def _coverage(t: Tables) -> DataFrame:
    customers = t.customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.bool_or(F.col("c_acctbal") > 9900).alias("rich"), F.min(F.struct(F.negative("c_acctbal").alias("b"), "c_custkey")).alias("best"))
    suppliers = t.supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.bool_or(F.col("s_acctbal") > 5000).alias("supplied"))
    rows = t.nation.join(customers, "n_nationkey", "left").join(suppliers, "n_nationkey", "left")
    return rows.select("n_nationkey", F.col("best").isNotNull().alias("held"), F.coalesce("rich", F.lit(False)).alias("rich"), F.coalesce("supplied", F.lit(False)).alias("supplied"), F.col("best.c_custkey").alias("preferred"))


@query(_COVERAGE)
def q18_coverage_detail(t: Tables) -> DataFrame:
    """EXISTS flags and a preferred id for each nation, each child table aggregated once."""
    return _coverage(t)


@query(f"SELECT count(*) AS total, count_if(rich) AS rich, count_if(supplied AND NOT rich) AS supplied_only, count_if(NOT supplied AND NOT rich) AS neither FROM ({_COVERAGE})")
def q19_index_summary(t: Tables) -> DataFrame:
    """Held, obtainable and missing, in one row."""
    return _coverage(t).agg(F.count("*").alias("total"), F.count_if("rich").alias("rich"), F.count_if(F.expr("supplied AND NOT rich")).alias("supplied_only"), F.count_if(F.expr("NOT supplied AND NOT rich")).alias("neither"))


@query("""
SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey GROUP BY l_orderkey HAVING bool_or(l_returnflag = 'N') OR (bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')))
""")
def q20_supersession(t: Tables) -> DataFrame:
    """Orders that no whole replacement and no two halves cover."""
    flag = F.col("l_returnflag")
    parts = t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey")
    return state.superseded(t.orders.select("o_orderkey", "o_custkey"), parts, "o_orderkey", flag == "N", (flag == "A", flag == "R"))


@query("""
SELECT event_id, user_id, CAST(row_number() OVER w AS INTEGER) AS used, row_number() OVER w <= 2 AS allowed FROM events WINDOW w AS (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id)
""")
def q25_quota_tumbling(t: Tables) -> DataFrame:
    """A tumbling quota: how much of it each event uses, and whether it is allowed."""
    return state.within_quota(t.events, ["user_id"], "ts", "day", 2, ["ts", "event_id"]).select("event_id", "user_id", "used", "allowed")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) AS recent FROM events")
def q26_sliding_cap(t: Tables) -> DataFrame:
    """Events of the same user in the six hours before each."""
    recent = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)")
    return t.events.select("event_id", recent.alias("recent"))


_GAPS = """
WITH g AS (SELECT user_id, event_id, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, CAST(sum(CASE WHEN gap_s > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS BIGINT) AS session FROM g)
"""


@query(_GAPS + "SELECT user_id, session, count(*) AS n, round(coalesce(sum(CASE WHEN gap_s <= 14400 THEN gap_s END), 0), 3) AS active_s FROM s GROUP BY 1, 2")
def q27_sessions(t: Tables) -> DataFrame:
    """Sessions cut at gaps of more than four hours, and the active time in them."""
    rows = state.idle_sessions(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", 14400, ["event_id"])
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum(F.when(F.col("gap_s") <= 14400, F.col("gap_s"))), F.lit(0.0)), 3).alias("active_s"))


@query(_GAPS + "SELECT count_if(gap_s <= 14400) AS kept, count_if(gap_s > 14400) AS dropped, round(quantile_cont(gap_s, 0.25) FILTER (WHERE gap_s <= 14400), 3) AS q1, round(quantile_cont(gap_s, 0.5) FILTER (WHERE gap_s <= 14400), 3) AS median, round(quantile_cont(gap_s, 0.75) FILTER (WHERE gap_s <= 14400), 3) AS q3 FROM s")
def q27b_idle_cut(t: Tables) -> DataFrame:
    """Time per item with idle gaps dropped and counted, median and quartiles."""
    rows = state.idle_sessions(t.events.select("user_id", "event_id", "ts"), ["user_id"], "ts", 14400, ["event_id"])
    kept = F.when(F.col("gap_s") <= 14400, F.col("gap_s"))
    return rows.agg(F.count(kept).alias("kept"), F.count_if(F.col("gap_s") > 14400).alias("dropped"), stats.percentiles(kept, (25, 50, 75)).alias("p")).select("kept", "dropped", *(F.round(F.col("p")[k], 3).alias(name) for k, name in enumerate(("q1", "median", "q3"))))


_JOBS = "SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END AS status, CAST(floor(value / 50) AS BIGINT) AS priority, ts AS created_at, event_id % 4 AS attempts FROM events"


@query(f"SELECT id, status, priority, row_number() OVER (ORDER BY status <> 'queued', priority DESC, created_at, id) AS place FROM ({_JOBS}) WHERE attempts < 3 AND (status = 'queued' OR (status = 'running' AND created_at < TIMESTAMP '2024-01-20' - INTERVAL 3 HOUR)) ORDER BY place LIMIT 100")
def q28_job_queue(t: Tables) -> DataFrame:
    """The next hundred jobs to claim: queued ones by priority, then stale running ones."""
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "click", "running").when(kind == "error", "error").otherwise("done")
    jobs = t.events.select(F.col("event_id").alias("id"), status.alias("status"), F.floor(F.col("value") / 50).cast("long").alias("priority"), F.col("ts").alias("created_at"), F.col("ts").alias("started_at"), (F.col("event_id") % 4).alias("attempts"))
    first = state.claim_order(jobs, "2024-01-20 00:00:00").limit(100)
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("status") != "queued", F.desc("priority"), "created_at", "id")
    return first.select("id", "status", "priority", F.row_number().over(order).cast("long").alias("place"))


@query("""
SELECT event_id, user_id, coalesce((SELECT max(ts) FROM events d WHERE d.user_id = e.user_id AND d.event_type = 'purchase') > ts, false) AS cancelled FROM events e WHERE event_type = 'error'
""")
def q29_failed_superseded(t: Tables) -> DataFrame:
    """Errors, and whether a later purchase of the same user cancels them."""
    rows = state.cancelled_failures(t.events, ["user_id"], "ts", F.col("event_type") == "error", F.col("event_type") == "purchase")
    return rows.select("event_id", "user_id", "cancelled")


@query("""
WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 1),
new AS (SELECT o_orderkey, CASE WHEN o_totalprice > 490000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 7 <> 2)
SELECT o_orderkey, CASE WHEN old.o_totalprice IS NULL THEN 'added' WHEN new.o_totalprice IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old FULL JOIN new USING (o_orderkey) WHERE old.o_totalprice IS NULL OR new.o_totalprice IS NULL OR old.o_orderstatus <> new.o_orderstatus
""")
def q53_snapshot_changes(t: Tables) -> DataFrame:
    """Added, removed and changed keys between two snapshots derived from orders."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    old = rows.where("o_orderkey % 7 <> 1")
    new = rows.where("o_orderkey % 7 <> 2").withColumn("o_orderstatus", F.when(F.col("o_totalprice") > 490000, "X").otherwise(F.col("o_orderstatus")))
    return state.changes(old, new, "o_orderkey", ["o_orderstatus", "o_totalprice"])


@query("""
WITH b AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS base, p_size FROM part),
y AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY base) = 1 THEN base ELSE base || '-' || p_size END AS dated FROM b)
SELECT p_partkey, CASE WHEN row_number() OVER d = 1 THEN dated ELSE dated || '-' || row_number() OVER d END AS slug FROM y WINDOW d AS (PARTITION BY dated ORDER BY p_partkey)
""")
def q54_slug_minting(t: Tables) -> DataFrame:
    """Unique slugs: the name, then the name and its size, then a number."""
    from tessera.functions import stats, text

    base = t.part.select("p_partkey", text.slug(F.col("p_name")).alias("base"), "p_size")
    dated = base.withColumn("dated", F.when(F.count("*").over(Window.partitionBy("base")) == 1, F.col("base")).otherwise(F.concat_ws("-", "base", "p_size")))
    n = F.row_number().over(Window.partitionBy("dated").orderBy("p_partkey"))
    return dated.select("p_partkey", F.when(n == 1, F.col("dated")).otherwise(F.concat_ws("-", "dated", n.cast("string"))).alias("slug"))
