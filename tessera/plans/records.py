"""Searches over several sources, matching, change classes, samples and record rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import rank, resolve, score, spatial
from tessera.plans.registry import Tables, query

_NAMES = "SELECT 'part' AS kind, p_name AS name, p_partkey AS id, p_type AS facet FROM part UNION ALL SELECT 'customer', c_name, c_custkey, c_mktsegment FROM customer UNION ALL SELECT 'supplier', s_name, s_suppkey, 'supplier' FROM supplier"


@query(f"""
WITH hit AS (SELECT * FROM ({_NAMES}) WHERE contains(lower(name), 'r') AND contains(lower(name), '1') OR contains(lower(name), 'red')),
page AS (SELECT kind, name, id, row_number() OVER (ORDER BY kind, name, id) AS n FROM hit WHERE kind IN ('part', 'supplier') ORDER BY n LIMIT 40)
SELECT 'kind' AS section, kind AS value, '' AS name, count(*) AS n FROM hit WHERE facet IN ('PROMO', 'supplier', 'BUILDING') GROUP BY kind
UNION ALL SELECT 'facet', facet, '', count(*) FROM hit WHERE kind IN ('part', 'supplier') GROUP BY facet
UNION ALL SELECT 'page', kind || ':' || id, name, n FROM page
""")
def q58_multi_source_search(t: Tables) -> DataFrame:
    """One query over three sources: facets that ignore their own choice, and a page in a stable order."""
    from tessera.operators import facets

    names = t.part.select(F.lit("part").alias("kind"), F.col("p_name").alias("name"), F.col("p_partkey").alias("id"), F.col("p_type").alias("facet"))
    names = names.union(t.customer.select(F.lit("customer"), "c_name", "c_custkey", "c_mktsegment")).union(t.supplier.select(F.lit("supplier"), "s_name", "s_suppkey", F.lit("supplier")))
    hit = names.where(text.contains_all(F.col("name"), ["r", "1"]) | text.contains_all(F.col("name"), ["red"]))
    tested = facets.tested(hit, {"kind": F.col("kind").isin("part", "supplier"), "facet": F.col("facet").isin("PROMO", "supplier", "BUILDING")})
    counts = facets.facet_counts(tested, {"kind": F.col("kind"), "facet": F.col("facet")}).select(F.col("dim").alias("section"), "value", F.lit("").alias("name"), "n")
    page = facets.keyset_page(hit.where(F.col("kind").isin("part", "supplier")), [F.col("kind"), F.col("name"), F.col("id")], 40)
    return counts.union(page.select(F.lit("page"), F.concat_ws(":", "kind", F.col("id").cast("string")), "name", F.col("place").cast("long")))


@query("""
SELECT lang, count_if(source = 'src1') AS src1, count_if(source = 'src2') AS src2, count_if(source = 'src3') AS src3, count_if(source NOT IN ('src1', 'src2', 'src3')) AS other FROM documents GROUP BY lang
""")
def q59_count_matrix(t: Tables) -> DataFrame:
    """A cross-tabulation with named columns: one aggregation, no pivot over unknown values."""
    source = F.when(F.col("source").isin("src1", "src2", "src3"), F.col("source")).otherwise("other")
    rows = t.documents.select("lang", source.alias("kind"))
    return rows.groupBy("lang").pivot("kind", ["src1", "src2", "src3", "other"]).count().na.fill(0)


def _box_tables(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, c = F.col("p_partkey"), F.col("c_custkey")
    a = t.part.select((k % 10).alias("sheet"), k.alias("a_id"), (k * 37 % 2000).cast("double").alias("ax"), (k * 91 % 2000).cast("double").alias("ay"), (F.lit(40.0) + F.col("p_size")).alias("aw"), (F.lit(30.0) + F.col("p_size")).alias("ah"))
    b = t.customer.select((c % 10).alias("sheet"), c.alias("b_id"), (c * 37 % 2000 + c % 23).cast("double").alias("bx"), (c * 91 % 2000 + c % 19).cast("double").alias("by"), F.lit(60.0).alias("bw"), F.lit(50.0).alias("bh"))
    return a, b


def _boxes(t: Tables) -> DataFrame:
    return spatial.overlapping_boxes(*_box_tables(t), 100.0, ["sheet"])


@query()
def q60_greedy_match(t: Tables) -> DataFrame:
    """One-to-one box matches on each sheet, highest IoU first."""
    return score.greedy_boxes(*_box_tables(t), "sheet", "a_id", "b_id", 50.0, 0.3, 9)


_BOXES = """
a AS (SELECT p_partkey % 10 AS sheet, p_partkey AS a_id, CAST(p_partkey * 37 % 2000 AS DOUBLE) AS ax, CAST(p_partkey * 91 % 2000 AS DOUBLE) AS ay, 40.0::DOUBLE + p_size AS aw, 30.0::DOUBLE + p_size AS ah FROM part),
b AS (SELECT c_custkey % 10 AS sheet, c_custkey AS b_id, CAST(c_custkey * 37 % 2000 + c_custkey % 23 AS DOUBLE) AS bx, CAST(c_custkey * 91 % 2000 + c_custkey % 19 AS DOUBLE) AS b_y, 60.0::DOUBLE AS bw, 50.0::DOUBLE AS bh FROM customer),
i AS (SELECT sheet, a_id, b_id, greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, b_y + bh) - greatest(ay, b_y)) AS s, aw * ah + bw * bh AS u FROM a JOIN b USING (sheet)),
o AS (SELECT sheet, a_id, b_id, s / (u - s) AS iou FROM i WHERE s > 0)
"""


@query(f"""
WITH {_BOXES}, l AS (SELECT *, count(*) OVER (PARTITION BY a_id) AS n_new, count(*) OVER (PARTITION BY b_id) AS n_old FROM o WHERE iou >= 0.1),
c AS (SELECT *, CASE WHEN n_new = 1 AND n_old = 1 THEN CASE WHEN iou >= 0.8 THEN 'unchanged' ELSE 'reshaped' END WHEN n_old = 1 THEN 'split' WHEN n_new = 1 THEN 'merged' ELSE 'complex' END AS class FROM l),
x AS (SELECT a_id, CASE WHEN count(DISTINCT class) > 1 THEN 'complex' ELSE min(class) END AS class FROM c GROUP BY 1), y AS (SELECT b_id, CASE WHEN count(DISTINCT class) > 1 THEN 'complex' ELSE min(class) END AS class FROM c GROUP BY 1)
SELECT p_partkey AS id, 'old' AS side, coalesce(class, 'gone') AS class FROM part LEFT JOIN x ON a_id = p_partkey UNION ALL SELECT c_custkey, 'new', coalesce(class, 'new') FROM customer LEFT JOIN y ON b_id = c_custkey
""")
def q61_change_classes(t: Tables) -> DataFrame:
    """What became of each box: unchanged, reshaped, split, merged, complex, gone or new."""
    return score.box_changes(*_box_tables(t), "sheet", "a_id", "b_id", 50.0, 0.1)


@query("""
WITH b AS (SELECT c_custkey, CAST(c_custkey * 37 % 1000 AS DOUBLE) AS x0, CAST(c_custkey * 91 % 1000 AS DOUBLE) AS y0 FROM customer),
p AS (SELECT c_custkey, x0 + (u.k + 0.5::DOUBLE) / 7 * 120 AS px, y0 + (v.k + 0.5::DOUBLE) / 7 * 80 AS py FROM b, (SELECT unnest(range(7)) AS k) u, (SELECT unnest(range(7)) AS k) v)
SELECT c_custkey, 'r' || CAST(floor(px / 250) AS INTEGER) || CAST(floor(py / 250) AS INTEGER) AS region, round(count(*) / 49.0::DOUBLE, 6) AS share FROM p WHERE px < 1000 AND py < 1000 GROUP BY 1, 2 HAVING count(*) / 49.0::DOUBLE >= 0.1
""")
def q62_region_shares(t: Tables) -> DataFrame:
    """Regions of each box by a grid of sample points, shares of a tenth and more."""
    c = F.col("c_custkey")
    x0, y0 = (c * 37 % 1000).cast("double"), (c * 91 % 1000).cast("double")
    boxes = t.customer.select("c_custkey", x0.alias("x0"), y0.alias("y0"), (x0 + 120).alias("x1"), (y0 + 80).alias("y1"))
    cell = lambda v: F.floor(F.col(v) / 250).cast("int").cast("string")
    region = F.when((F.col("px") < 1000) & (F.col("py") < 1000), F.concat(F.lit("r"), cell("px"), cell("py")))
    return score.sampled_shares(boxes, "c_custkey", region, 7, 0.1).withColumn("share", F.round("share", 6))


@query("SELECT l_partkey AS edge, min(l_suppkey) AS first, max(l_suppkey) AS second, round(max(l_extendedprice) - min(l_extendedprice), 2) AS l_extendedprice FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 2")
def q63_seam_census(t: Tables) -> DataFrame:
    """Edges that exactly two sheets hold, and how far they differ there."""
    edges = t.lineitem.select(F.col("l_partkey").alias("edge"), "l_suppkey", "l_extendedprice")
    return score.seams(edges, "edge", "l_suppkey", ["l_extendedprice"]).withColumn("l_extendedprice", F.round("l_extendedprice", 2))


@query("SELECT o_orderpriority, o_totalprice AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)) WHERE k = least(floor(0.9::DOUBLE * n), n - 1)")
def q64_work_selection(t: Tables) -> DataFrame:
    """The budget's upper quantile, not interpolated, over the work that nothing excludes."""
    open_ = t.orders.join(t.customer.where("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti")
    return score.lower_quantile(open_, ["o_orderpriority"], "o_totalprice", 0.9)


@query("SELECT p_type, p_partkey, CAST(row_number() OVER w AS INTEGER) AS place, count(*) OVER (PARTITION BY p_type) AS full_count FROM part WINDOW w AS (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) QUALIFY row_number() OVER w <= 7")
def q65_slice_groups(t: Tables) -> DataFrame:
    """The first seven rows of each group with the group's full count."""
    return rank.slice_groups(t.part, ["p_type"], [F.desc("p_retailprice"), F.col("p_partkey")], 7).select("p_type", "p_partkey", "place", "full_count")


@query("""
WITH b AS (SELECT *, l_partkey * 37 % 2000 AS x, l_partkey * 91 % 2000 AS y FROM lineitem)
SELECT l_orderkey, min(x) AS x0, min(y) AS y0, max(x) + 40 AS x1, max(y) + 30 AS y1, count(*) AS n, string_agg(CAST(l_partkey AS VARCHAR), ' ' ORDER BY y, x, l_partkey) AS parts FROM b GROUP BY 1 HAVING count(*) > 1
""")
def q66_group_envelopes(t: Tables) -> DataFrame:
    """Groups of boxes: envelope, and members in reading order."""
    k = F.col("l_partkey")
    boxes = t.lineitem.select("l_orderkey", k.alias("part"), (k * 37 % 2000).alias("x"), (k * 91 % 2000).alias("y"))
    read = F.array_sort(F.collect_list(F.struct("y", "x", "part")))
    groups = boxes.groupBy("l_orderkey").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 40).alias("x1"), (F.max("y") + 30).alias("y1"), F.count("*").alias("n"), read.alias("members")).where("n > 1")
    return groups.select("l_orderkey", "x0", "y0", "x1", "y1", "n", F.array_join(F.transform("members", lambda m: m["part"].cast("string")), " ").alias("parts"))


@query("""
WITH c AS (SELECT o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS status, CASE WHEN o_orderpriority NOT LIKE '4%' THEN o_orderpriority END AS priority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT c_custkey, coalesce(status, 'unknown') AS status, coalesce(priority, c_mktsegment) AS label FROM customer LEFT JOIN c ON o_custkey = c_custkey
""")
def q67_canonical_sync(t: Tables) -> DataFrame:
    """Fields of each customer's canonical order over its own; nulls never overwrite."""
    from tessera.operators import state

    last = state.latest(t.orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    fields = last.select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("status"), F.when(~F.col("o_orderpriority").startswith("4"), F.col("o_orderpriority")).alias("priority"))
    return t.customer.join(fields, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("status", F.lit("unknown")).alias("status"), F.coalesce("priority", "c_mktsegment").alias("label"))


@query("""
WITH n AS (SELECT p_name, count(*) AS n FROM part GROUP BY 1) SELECT n AS instances, count(*) AS names FROM n GROUP BY 1
""")
def q68_repeat_histogram(t: Tables) -> DataFrame:
    """How many names occur how often."""
    return t.part.groupBy("p_name").agg(F.count("*").alias("instances")).groupBy("instances").agg(F.count("*").alias("names"))


@query("""
WITH s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'validated' ELSE 'rejected' END AS status, lag(CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'validated' ELSE 'rejected' END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS old FROM events)
SELECT coalesce(old, 'none') AS old, status, count(*) AS n, count_if(coalesce((old = 'pending' AND status IN ('validated', 'rejected')) OR (old = 'validated' AND status IN ('pending', 'rejected')) OR (old = 'rejected' AND status = 'pending'), false)) AS allowed FROM s GROUP BY 1, 2
""")
def q69_status_steps(t: Tables) -> DataFrame:
    """Changes of status that happened, and how many are allowed."""
    status = F.when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "click", "validated").otherwise("rejected")
    steps = t.events.withColumn("status", status).withColumn("old", F.lag("status").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return steps.groupBy(F.coalesce("old", F.lit("none")).alias("old"), "status").agg(F.count("*").alias("n"), F.count_if(score.allowed_step(F.col("old"), F.col("status"))).alias("allowed"))


@query("""
SELECT CASE WHEN l_tax > 0.06 THEN 'taxed' ELSE l_linestatus END AS kind, count(*) AS n, round(sum(CASE WHEN l_discount > 0.08 THEN l_extendedprice * 0.5 ELSE l_extendedprice END), 2) AS value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1
""")
def q70_corrected_overlay(t: Tables) -> DataFrame:
    """Corrected values over raw ones, rejected rows left out, then summed."""
    rows = t.lineitem.select(F.col("l_linestatus").alias("kind"), F.when(F.col("l_tax") > 0.06, "taxed").alias("kind_corrected"), F.col("l_extendedprice").alias("value"), F.when(F.col("l_discount") > 0.08, F.col("l_extendedprice") * 0.5).alias("value_corrected"), F.when(F.col("l_returnflag") == "R", "rejected").alias("status"))
    seen = score.effective(rows, {"kind": "kind_corrected", "value": "value_corrected"}, "status")
    return seen.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("value"))


@query("""
WITH c AS (SELECT year(o_orderdate) AS year, count(*) AS n, count_if(o_totalprice > 499000) AS hits FROM orders GROUP BY 1), h AS (SELECT year FROM c WHERE hits > 0)
SELECT year, n, hits, (SELECT min(h.year) FROM h WHERE abs(h.year - c.year) = (SELECT min(abs(g.year - c.year)) FROM h g)) AS nearest FROM c
""")
def q71_curve_with_fallback(t: Tables) -> DataFrame:
    """Counts by year, and for each year the nearest one with hits (the earlier of two)."""
    curve = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 499000).alias("hits"))
    w = Window.partitionBy(F.lit(0)).orderBy("year")  # one row for each year
    hit = F.when(F.col("hits") > 0, F.col("year"))
    sided = curve.withColumn("back", F.last(hit, True).over(w)).withColumn("ahead", F.first(hit, True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    nearest = F.when(F.col("ahead").isNull() | (F.col("year") - F.col("back") <= F.col("ahead") - F.col("year")), F.col("back")).otherwise(F.col("ahead"))
    return sided.select("year", "n", "hits", nearest.alias("nearest"))


@query("""
WITH RECURSIVE k AS (SELECT p_partkey, p_name, p_size, p_retailprice FROM part),
e AS (SELECT a.p_partkey AS a, b.p_partkey AS b FROM k a JOIN k b ON a.p_name = b.p_name AND abs(a.p_size - b.p_size) <= 1 AND a.p_partkey <> b.p_partkey),
r(node, label) AS (SELECT a, a FROM e UNION SELECT e.b, r.label FROM r JOIN e ON e.a = r.node), l AS (SELECT node, min(label) AS label FROM r GROUP BY 1),
x AS (SELECT k.*, coalesce(label, p_partkey) AS label FROM k LEFT JOIN l ON node = p_partkey)
SELECT label, p_partkey, count(*) OVER (PARTITION BY label) AS members FROM x QUALIFY row_number() OVER (PARTITION BY label ORDER BY p_retailprice DESC, p_partkey) = 1
""")
def q72_dedup_survivors(t: Tables) -> DataFrame:
    """Same name and near size are one thing: components, and the best row of each."""
    rows = t.part.select("p_partkey", "p_name", "p_size", "p_retailprice")
    labels = resolve.components(resolve.stars(rows, ["p_name"], "p_size", "p_partkey"))
    return resolve.survivors(rows, labels, "p_partkey", [F.desc("p_retailprice")]).select("label", "p_partkey", "members")
