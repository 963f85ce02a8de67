"""Summaries, fits, scores and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import stats, text
from tessera.operators import rank
from tessera.plans.registry import Tables, query


@query("SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 4) AS p{p}" for p in (10, 25, 50, 75, 90, 99)) + ", count(*) AS n FROM lineitem GROUP BY 1")
def q30_percentile_summary(t: Tables) -> DataFrame:
    """Interpolated percentiles by group."""
    points = (10, 25, 50, 75, 90, 99)
    out = t.lineitem.groupBy("l_returnflag").agg(stats.percentiles(F.col("l_extendedprice"), points).alias("p"), F.count("*").alias("n"))
    return out.select("l_returnflag", *(F.round(F.col("p")[k], 4).alias(f"p{p}") for k, p in enumerate(points)), "n")


@query("SELECT l_returnflag, round(degrees(atan2(sum(sin(radians(2 * a))), sum(cos(radians(2 * a))))) / 2, 3) AS axis FROM (SELECT l_returnflag, (l_quantity * l_quantity * 0.05) % 180 AS a FROM lineitem) GROUP BY 1")
def q31_axial_stats(t: Tables) -> DataFrame:
    """Mean direction of undirected angles."""
    angle = (F.col("l_quantity") * F.col("l_quantity") * 0.05) % 180
    return t.lineitem.groupBy("l_returnflag").agg(F.round(stats.axial_mean(angle), 3).alias("axis"))


@query("""
WITH s AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS m1, avg(l_discount) AS m2, avg(l_extendedprice) AS my, covar_pop(l_quantity, l_quantity) AS c11, covar_pop(l_quantity, l_discount) AS c12, covar_pop(l_discount, l_discount) AS c22, covar_pop(l_quantity, l_extendedprice) AS c1y, covar_pop(l_discount, l_extendedprice) AS c2y FROM lineitem GROUP BY 1)
SELECT l_returnflag, round((c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12), 2) AS b1, round((c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12), 2) AS b2,
  round(my - m1 * (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) - m2 * (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12), 2) AS b0 FROM s
""")
def q32_affine_fit(t: Tables) -> DataFrame:
    """Least squares with two regressors from nine sums."""
    sums = t.lineitem.groupBy("l_returnflag").agg(*stats.linear_fit(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount")))
    return sums.select("l_returnflag", *(F.round(v, 2).alias(k) for k, v in stats.solve_fit().items()))


@query("""
WITH p AS (SELECT quality, CAST(length(text) > 400 AND NOT contains(text, '!!') AND NOT contains(text, ' | ') AS INTEGER) AS guess, lang FROM labels JOIN documents USING (doc_id)),
s AS (SELECT lang, count_if(quality = 1 AND guess = 1) AS tp, count_if(guess = 1) AS predicted, count_if(quality = 1) AS actual FROM p GROUP BY 1)
SELECT lang, tp, predicted, actual, round(tp / predicted, 4) AS "precision", round(tp / actual, 4) AS recall, round(2.0 * tp / (predicted + actual), 4) AS f1 FROM s
""")
def q40_score_prf(t: Tables) -> DataFrame:
    """Precision, recall and F1 of a rule against labels, by language."""
    guess = (F.length("text") > 400) & ~F.contains("text", F.lit("!!")) & ~F.contains("text", F.lit(" | "))
    rows = t.labels.join(t.documents, "doc_id").select("lang", F.col("quality") == 1, guess.alias("guess")).toDF("lang", "good", "guess")
    sums = rows.groupBy("lang").agg(F.count_if(F.col("good") & F.col("guess")).alias("tp"), F.count_if("guess").alias("predicted"), F.count_if("good").alias("actual"))
    return sums.withColumns(stats.f_measures(F.col("tp"), F.col("predicted"), F.col("actual")))


@query("""
WITH p AS (SELECT quality, length(text) AS n FROM labels JOIN documents USING (doc_id))
SELECT cut, count_if(n >= cut) AS kept, count_if(n >= cut AND quality = 1) AS good, round(count_if(n >= cut AND quality = 1) / nullif(count_if(n >= cut), 0), 4) AS "precision", round(count_if(n >= cut AND quality = 1) / nullif(count_if(quality = 1), 0), 4) AS recall
FROM p, (SELECT unnest(range(0, 5001, 500)) AS cut) GROUP BY cut
""")
def q41_threshold_sweep(t: Tables) -> DataFrame:
    """Precision and recall at every cut of a grid: rows are counted by grid step once, then summed up."""
    rows = t.labels.join(t.documents, "doc_id").select("quality", F.least(F.lit(10), F.floor(F.length("text") / 500)).cast("int").alias("step"))
    steps = rows.groupBy("step").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"))
    # Eleven rows on either side.
    cuts = t.spark.range(0, 11).select(F.col("id").cast("int").alias("at"))
    swept = cuts.join(steps, F.col("step") >= F.col("at"), "left").groupBy("at").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kept"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"))
    total = steps.agg(F.sum("good").alias("all_good"))
    return swept.crossJoin(F.broadcast(total)).select((F.col("at") * 500).cast("long").alias("cut"), "kept", "good", F.round(F.try_divide("good", "kept"), 4).alias("precision"), F.round(F.try_divide("good", "all_good"), 4).alias("recall"))


@query("""
WITH v AS (SELECT conv_id, text AS reading, count(*) AS votes, max(length(text)) AS longest FROM conversations WHERE text <> '' GROUP BY 1, 2)
SELECT conv_id, reading, votes, (SELECT sum(votes) FROM v w WHERE w.conv_id = v.conv_id)::BIGINT AS passes FROM v QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY votes DESC, longest DESC, reading) = 1
""")
def q43_ensemble_vote(t: Tables) -> DataFrame:
    """Merge readings of one thing: most votes, ties by the longest, then the first."""
    votes = t.conversations.where("text <> ''").groupBy("conv_id", F.col("text").alias("reading")).agg(F.count("*").alias("votes"), F.max(F.length("text")).alias("longest"))
    best = votes.groupBy("conv_id").agg(F.min(F.struct(F.negative("votes").alias("v"), F.negative("longest").alias("l"), "reading")).alias("b"), F.sum("votes").alias("passes"))
    return best.select("conv_id", "b.reading", F.negative("b.v").alias("votes"), "passes")


@query("""
WITH r AS (SELECT doc_id, contains(lower(text), 'license') AS licence, regexp_matches(text, '[0-9]{4,}') AS numbers, length(text) > 3000 AS long, lang <> 'en' AS foreign_ FROM documents),
s AS (SELECT doc_id, 40 * licence::INT + 25 * numbers::INT + 20 * long::INT + 15 * foreign_::INT AS score, CASE WHEN licence THEN 'licence' WHEN numbers THEN 'numbers' WHEN long THEN 'long' WHEN foreign_ THEN 'foreign' END AS category FROM r)
SELECT doc_id, score, category, CASE WHEN score >= 60 THEN 'high' WHEN score >= 30 THEN 'medium' WHEN score >= 10 THEN 'low' ELSE 'none' END AS bucket FROM s
""")
def q44_rule_score(t: Tables) -> DataFrame:
    """Additive rules, the first rule as category, and a bucket."""
    rules = [("licence", F.contains(F.lower("text"), F.lit("license")), 40), ("numbers", F.col("text").rlike("[0-9]{4,}"), 25), ("long", F.length("text") > 3000, 20), ("foreign", F.col("lang") != "en", 15)]
    score, category = rank.rule_score(rules)
    return t.documents.select("doc_id", score.alias("score"), category.alias("category")).withColumn("bucket", rank.score_bucket(F.col("score"), [(60, "high"), (30, "medium"), (10, "low")], "none"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '1998-06-15' THEN 'before' WHEN o_orderdate > TIMESTAMP '1998-06-15' THEN 'after' ELSE 'at' END AS side FROM orders)
SELECT o_custkey, side, o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place FROM s
WINDOW w AS (PARTITION BY o_custkey, side ORDER BY CASE WHEN side = 'before' THEN o_orderdate END DESC NULLS LAST, o_orderdate, o_orderkey)
QUALIFY row_number() OVER w <= 2
""")
def q45_nearest_each_side(t: Tables) -> DataFrame:
    """Two orders before and two after a date for each customer."""
    rows = rank.nearest_each_side(t.orders, ["o_custkey"], "o_orderdate", F.lit("1998-06-15").cast("timestamp_ntz"), 2, ["o_orderkey"])
    return rows.select("o_custkey", "side", "o_orderkey", "place")


@query("""
WITH b AS (SELECT o_orderpriority, o_orderkey, CAST(year(o_orderdate) * 4 + quarter(o_orderdate) - 1 AS BIGINT) AS bin, o_totalprice FROM orders),
pick AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY o_orderpriority, bin ORDER BY o_totalprice DESC, o_orderkey) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM pick)
SELECT o_orderpriority, bin, o_orderkey FROM k WHERE n <= 10 OR k = round(round(k * 9.0::DOUBLE / (n - 1)) * (n - 1) / 9.0::DOUBLE)
""")
def q46_bin_pick_thin(t: Tables) -> DataFrame:
    """The best order of each quarter, thinned evenly to ten for each priority."""
    rows = t.orders.select("o_orderpriority", "o_orderkey", F.expr("year(o_orderdate) * 4 + quarter(o_orderdate) - 1").cast("long").alias("bin"), "o_totalprice")
    picks = rank.best_in_bin(rows, ["o_orderpriority", "bin"], [F.desc("o_totalprice"), F.col("o_orderkey")])
    return rank.thin(picks, ["o_orderpriority"], ["bin"], 10).select("o_orderpriority", "bin", "o_orderkey")


@query("""
WITH s AS (SELECT p_partkey, p_name, 2 * len(list_intersect(string_split(lower(p_name), ' '), ['red', 'plate'])) + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END + round(1 - least(abs(p_size - 25) / 25.0, 1), 6) AS score, abs(p_size - 25) AS distance FROM part)
SELECT p_partkey, p_name, round(score, 6) AS score, distance FROM s ORDER BY score DESC, distance, p_partkey LIMIT 25
""")
def q47_candidate_rank(t: Tables) -> DataFrame:
    """The top candidates by shared words, kind and distance."""
    shared = F.size(F.array_intersect(text.tokens(F.col("p_name")), F.array(F.lit("red"), F.lit("plate"))))
    distance = F.abs(F.col("p_size") - 25)
    score = 2 * shared + F.when(F.col("p_type") == "PROMO", 1).otherwise(0) + F.round(1 - F.least(distance / 25.0, F.lit(1.0)), 6)
    return t.part.select("p_partkey", "p_name", F.round(score, 6).alias("score"), distance.alias("distance")).orderBy(F.desc("score"), "distance", "p_partkey").limit(25)


@query("""
SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS calls, CAST(sum(l_quantity) AS BIGINT) AS tokens, count_if(l_discount = 0) AS unpriced, round(sum(l_extendedprice * (1 - l_discount)) / count(*), 2) AS per_call FROM lineitem GROUP BY 1
""")
def q48_spend_rollup(t: Tables) -> DataFrame:
    """Calls, tokens, unpriced calls and cost per call by month."""
    month = F.date_format("l_shipdate", "yyyy-MM").alias("month")
    cost = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    return t.lineitem.groupBy(month).agg(F.count("*").alias("calls"), F.sum("l_quantity").cast("long").alias("tokens"), F.count_if(F.col("l_discount") == 0).alias("unpriced"), F.round(F.try_divide(cost, F.count("*")), 2).alias("per_call"))


@query("SELECT r_name, c_mktsegment, count(*) AS n, CAST(grouping(r_name) * 2 + grouping(c_mktsegment) AS BIGINT) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, c_mktsegment)")
def q49_rollup(t: Tables) -> DataFrame:
    """Subtotals by region and segment."""
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "c_mktsegment").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


@query("""
SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT count(*) FROM orders WHERE o_totalprice > 400000) AS large_orders, (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returned,
  (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS in_debt, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, (SELECT count(DISTINCT user_id) FROM events) AS users, (SELECT count(*) FROM documents WHERE lang = 'fr') AS french
""")
def q50_status_snapshot(t: Tables) -> DataFrame:
    """Counts over five tables in one row, each table read once."""
    parts = [
        t.orders.agg(F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.count_if(F.col("o_totalprice") > 400000).alias("large_orders")),
        t.lineitem.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned")),
        t.customer.agg(F.count_if(F.col("c_acctbal") < 0).alias("in_debt")),
        t.events.agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users")),
        t.documents.agg(F.count_if(F.col("lang") == "fr").alias("french")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


@query("""
SELECT url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS links, CAST(len(regexp_extract_all(html, '<p>')) AS INTEGER) AS paragraphs, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang,
  length(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g'))) AS n_text FROM pages
""")
def q39_page_scrape(t: Tables) -> DataFrame:
    """Title, links, paragraphs, language and text length of each page, by patterns."""
    h = F.col("html")
    return t.pages.select(
        "url",
        F.regexp_extract(h, "<title>([^<]*)</title>", 1).alias("title"),
        F.size(F.regexp_extract_all(h, F.lit('<a href="([^"]*)"'), F.lit(1))).alias("links"),
        F.size(F.regexp_extract_all(h, F.lit("<p>"), F.lit(0))).alias("paragraphs"),
        F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"),
        F.length(text.html_text(h)).cast("long").alias("n_text"),
    )


@query("SELECT wilson.user_id, k, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM (SELECT user_id, count_if(event_type = 'error') AS k, count(*) AS n, count_if(event_type = 'error') / count(*) AS p FROM events GROUP BY 1) wilson")
def q55_wilson_interval(t: Tables) -> DataFrame:
    """Each user's share of errors with its Wilson interval."""
    sums = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("k"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return sums.select("user_id", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
