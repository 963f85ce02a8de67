"""Drift, orphans, duplicates, index gaps and suspects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import audit
from tessera.plans.registry import Tables, query


@query("""
SELECT 'customer without large order' AS "check", c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)
UNION ALL SELECT 'large order of poor customer', o_orderkey FROM orders WHERE o_totalprice > 450000 AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
""")
def q21_drift_anti_joins(t: Tables) -> DataFrame:
    """What one side has and the other lacks, in both directions."""
    large = t.orders.where("o_totalprice > 450000")
    a = t.customer.join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("customer without large order").alias("check"), F.col("c_custkey").alias("key"))
    b = large.join(t.customer.where("c_acctbal > 0"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.lit("large order of poor customer"), "o_orderkey")
    return a.union(b)


@query("""
SELECT 'FAIL' AS level, 'document without label' AS "check", CAST(doc_id AS VARCHAR) AS subject, count(*) || ' rows' AS detail FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY doc_id
UNION ALL SELECT 'WARN', 'nation without supplier', CAST(n_nationkey AS VARCHAR), count(*) || ' rows' FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier) GROUP BY n_nationkey
""")
def q22_orphan_keys(t: Tables) -> DataFrame:
    """Keys that the other table lacks."""
    return audit.findings(
        audit.dangling(t.documents, "doc_id", t.labels, "doc_id", "FAIL", "document without label"),
        audit.dangling(t.nation, "n_nationkey", t.supplier, "s_nationkey", "WARN", "nation without supplier"),
    )


@query("""
SELECT 'FAIL' AS level, 'negative balance' AS "check", CAST(c_custkey AS VARCHAR) AS subject, c_mktsegment AS detail FROM customer WHERE c_acctbal < -900
UNION ALL SELECT 'WARN', 'full discount and no tax', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_discount >= 0.1 AND l_tax = 0
UNION ALL SELECT 'FAIL', 'order key twice', CAST(o_orderkey AS VARCHAR), CAST(count(*) AS VARCHAR) FROM orders GROUP BY o_orderkey HAVING count(*) >= 2
UNION ALL SELECT 'WARN', 'line number repeated', l_orderkey || '|' || l_linenumber, CAST(count(*) AS VARCHAR) FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) >= 4
UNION ALL SELECT 'FAIL', 'line of no order', CAST(l_orderkey AS VARCHAR), count(*) || ' rows' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'WARN', 'markup in text', CAST(doc_id AS VARCHAR), source FROM documents WHERE regexp_matches(text, '<[a-z]+>|&[a-z]+;|https?://|@[a-z0-9]+\\.')
""")
def q23_catalog_audit(t: Tables) -> DataFrame:
    """Rule groups over several tables as (level, check, subject, detail)."""
    c = F.col
    return audit.findings(
        audit.rule(t.customer, "FAIL", "negative balance", c("c_acctbal") < -900, c("c_custkey"), c("c_mktsegment")),
        audit.rule(t.lineitem, "WARN", "full discount and no tax", (c("l_discount") >= 0.1) & (c("l_tax") == 0), c("l_orderkey"), c("l_partkey")),
        audit.duplicated(t.orders, ["o_orderkey"], "FAIL", "order key twice"),
        audit.duplicated(t.lineitem, ["l_orderkey", "l_linenumber"], "WARN", "line number repeated", 4),
        audit.dangling(t.lineitem, "l_orderkey", t.orders, "o_orderkey", "FAIL", "line of no order"),
        audit.rule(t.documents, "WARN", "markup in text", c("text").rlike(r"<[a-z]+>|&[a-z]+;|https?://|@[a-z0-9]+\."), c("doc_id"), c("source")),
    )


@query(f"SELECT sha256({text.fold_sql('text')}) AS key, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def q24_duplicate_groups(t: Tables) -> DataFrame:
    """Groups of documents whose folded texts are equal."""
    keyed = t.documents.select("doc_id", F.sha2(text.fold(F.col("text")), 256).alias("key"))
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("n > 1")


_MONTH = "year(o_orderdate) * 12 + month(o_orderdate)"


@query(f"""
WITH m AS (SELECT DISTINCT o_custkey, CAST({_MONTH} AS BIGINT) AS number FROM orders),
e AS (SELECT o_custkey, unnest(range(min(number), max(number) + 1)) AS number FROM m GROUP BY 1)
SELECT o_custkey, number FROM e ANTI JOIN m USING (o_custkey, number)
""")
def q51a_index_gaps(t: Tables) -> DataFrame:
    """Months without an order between each customer's first and last."""
    return audit.index_gaps(t.orders, ["o_custkey"], F.expr(_MONTH).cast("long"))


@query("""
WITH d AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS same FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, concat_ws(',', CASE WHEN l_quantity > 49 AND l_discount >= 0.09 THEN 'malformed' END, CASE WHEN p_partkey IS NULL THEN 'no-entry' END, CASE WHEN same > 1 THEN 'duplicate' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) AS reasons
FROM d LEFT JOIN (SELECT p_partkey FROM part WHERE p_size < 40) ON p_partkey = l_partkey
WHERE concat_ws(',', CASE WHEN l_quantity > 49 AND l_discount >= 0.09 THEN 'malformed' END, CASE WHEN p_partkey IS NULL THEN 'no-entry' END, CASE WHEN same > 1 THEN 'duplicate' END, CASE WHEN l_tax = 0 THEN 'untaxed' END) <> ''
""")
def q51b_suspects(t: Tables) -> DataFrame:
    """Suspect lines with their reasons in a fixed order."""
    entries = t.part.where("p_size < 40").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("known"))
    rows = t.lineitem.withColumn("same", F.count("*").over(Window.partitionBy("l_orderkey", "l_linenumber"))).join(entries, "l_partkey", "left")
    c = F.col
    why = audit.reasons([("malformed", (c("l_quantity") > 49) & (c("l_discount") >= 0.09)), ("no-entry", c("known").isNull()), ("duplicate", c("same") > 1), ("untaxed", c("l_tax") == 0)])
    return rows.withColumn("reasons", why).where("reasons IS NOT NULL").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "reasons")


_WORDS = "SELECT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM {0}"


@query(f"""
WITH a AS (SELECT word, count(*) AS in_old FROM ({_WORDS.format("benchmark")}) WHERE word <> '' GROUP BY 1), b AS (SELECT word, count(*) AS in_new FROM ({_WORDS.format("conversations")}) WHERE word <> '' GROUP BY 1)
SELECT word, coalesce(in_old, 0) AS in_old, coalesce(in_new, 0) AS in_new, CASE WHEN in_old IS NULL THEN 'new' WHEN in_new IS NULL THEN 'missing' WHEN in_old <> in_new THEN 'drifted' ELSE 'in sync' END AS change FROM a FULL JOIN b USING (word)
""")
def q51c_multiset_diff(t: Tables) -> DataFrame:
    """Difference of two multisets of words."""
    def words(df: DataFrame) -> DataFrame:
        return df.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("word <> ''")

    return audit.multiset_diff(words(t.benchmark), words(t.conversations), ["word"])


@query("""
WITH g AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, round(coalesce(sum(CASE WHEN abs(value - before) < 80 THEN abs(value - before) END), 0), 4) AS distance, count_if(abs(value - before) >= 80) AS jumps FROM g GROUP BY 1
""")
def q51d_spike_filtered_distance(t: Tables) -> DataFrame:
    """Distance travelled, without jumps; a jump becomes the next step's origin."""
    step = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    steps = t.events.select("user_id", step.alias("step"))
    return steps.groupBy("user_id").agg(F.round(F.coalesce(F.sum(F.when(F.col("step") < 80, F.col("step"))), F.lit(0.0)), 4).alias("distance"), F.count_if(F.col("step") >= 80).alias("jumps"))
