"""Faceted and text search over the catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import facets, rank, rollup
from tessera.plans.registry import Tables, query

PART_QUERY = "re b"
BRANDS = ["Brand#2", "Brand#4", "Brand#17"]
TYPES = ["ECONOMY", "SMALL", "PROMO"]
SIZES = (5, 45)


def _part_filters() -> dict[str, Column]:
    return {"brand": facets.any_of(F.col("p_brand"), BRANDS), "type": facets.any_of(F.col("p_type"), TYPES), "size": facets.in_range(F.col("p_size"), *SIZES)}


def _part_dims() -> dict[str, Column]:
    return {"brand": F.col("p_brand"), "type": F.col("p_type"), "size": (F.floor(F.col("p_size") / 10) * 10).cast("long")}


_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
_MATCH = f"p_brand IN ({_IN(BRANDS)}) AND p_type IN ({_IN(TYPES)}) AND p_size BETWEEN {SIZES[0]} AND {SIZES[1]}"
_SEARCHED = "SELECT * FROM part WHERE list_bool_or(list_transform(string_split(lower(p_name), ' '), lambda w: starts_with(w, 're'))) AND list_bool_or(list_transform(string_split(lower(p_name), ' '), lambda w: starts_with(w, 'b')))"
_FACETS = f"""
  SELECT 'brand' AS dim, p_brand AS value, count(*) AS n FROM {{0}} WHERE p_type IN ({_IN(TYPES)}) AND p_size BETWEEN {SIZES[0]} AND {SIZES[1]} GROUP BY 2
  UNION ALL SELECT 'type', p_type, count(*) FROM {{0}} WHERE p_brand IN ({_IN(BRANDS)}) AND p_size BETWEEN {SIZES[0]} AND {SIZES[1]} GROUP BY 2
  UNION ALL SELECT 'size', CAST(p_size // 10 * 10 AS VARCHAR), count(*) FROM {{0}} WHERE p_brand IN ({_IN(BRANDS)}) AND p_type IN ({_IN(TYPES)}) GROUP BY 2"""


@query(f"""
WITH searchable AS ({_SEARCHED}), hit AS (SELECT * FROM searchable WHERE {_MATCH}),
page AS (SELECT row_number() OVER (ORDER BY coalesce(p_size, 2147483648), p_name, p_partkey) AS k, p_partkey, p_name FROM hit),
facet AS ({_FACETS.format("searchable")})
SELECT 'total' AS section, '' AS key, '' AS value, count(*) AS n FROM hit
UNION ALL SELECT 'facet', dim, value, n FROM facet
UNION ALL SELECT 'choice', 'brand', p_brand, count(*) FROM searchable GROUP BY 3
UNION ALL SELECT 'bin', '', CAST(p_size // 10 * 10 AS VARCHAR), count(*) FROM hit GROUP BY 3
UNION ALL SELECT 'page', CAST(p_partkey AS VARCHAR), p_name, k FROM page WHERE k <= 60
UNION ALL SELECT 'more', '', '', CAST((SELECT count(*) FROM hit) > 60 AS BIGINT)
""")
def q01_explore_page(t: Tables) -> DataFrame:
    """One faceted page: page, total, disjunctive facets, choices and bins over the full result, as (section, key, value, n)."""
    words = text.tokens(F.col("p_name"))
    searchable = t.part.where(text.matches_prefixes(words, text.query_tokens(PART_QUERY)))
    tested = facets.tested(searchable, _part_filters())
    hit = facets.matched(tested)
    page = facets.keyset_page(hit, [F.coalesce(F.col("p_size").cast("long"), F.lit(facets.NO_YEAR)), F.col("p_name"), F.col("p_partkey")], 60)
    # Everything that is counted comes from one pass: each row says what it counts for.
    hits, value = F.size("failed") == 0, lambda c: c.cast("string")
    entries = [_entry(hits, "total", "", F.lit("")), _entry(hits, "bin", "", value(_part_dims()["size"])), _entry(F.lit(True), "choice", "brand", F.col("p_brand"))]
    for dim, column in _part_dims().items():
        entries.append(_entry(F.size(F.array_except("failed", F.array(F.lit(dim)))) == 0, "facet", dim, value(column)))
    counted = tested.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).select("e.*", F.lit(1).alias("n"))
    none = t.spark.range(1).select(F.lit("total").alias("section"), F.lit("").alias("key"), F.lit("").alias("value"), F.lit(0).alias("n"))
    sums = counted.union(none).groupBy("section", "key", "value").agg(F.sum("n").alias("n"))
    own = F.struct("section", "key", "value", "n")
    more = F.struct(F.lit("more").alias("section"), "key", "value", (F.col("n") > 60).cast("long").alias("n"))
    rows = sums.select(F.explode(F.when(F.col("section") == "total", F.array(own, more)).otherwise(F.array(own))).alias("r")).select("r.*")
    return rows.union(page.select(F.lit("page"), F.col("p_partkey").cast("string"), "p_name", F.col("place").cast("long")))


def _entry(test: Column, section: str, key: str, value: Column) -> Column:
    return F.when(test & value.isNotNull(), F.struct(F.lit(section).alias("section"), F.lit(key).alias("key"), value.alias("value")))


@query(_FACETS.format("part"))
def q02_facet_disjunctive(t: Tables) -> DataFrame:
    """Counts of every facet value against all other facets' choices."""
    return facets.facet_counts(facets.tested(t.part, _part_filters()), _part_dims())


@query("SELECT 'type' AS dim, p_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_type) AS place FROM part GROUP BY p_type")
def q03_facet_choices(t: Tables) -> DataFrame:
    """All choices of a facet, most frequent first."""
    from pyspark.sql import Window

    counts = facets.facet_counts(facets.tested(t.part, {}), {"type": F.col("p_type")}, every=True)
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value")).cast("long"))


_QUARTER = "year(o_orderdate) * 4 + quarter(o_orderdate) - 1"
_FINE = "CAST(floor(o_totalprice) AS BIGINT)"


@query(f"""
WITH b AS (SELECT CAST(floor({_FINE} / 25) AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1)
SELECT g.bin, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(bin) FROM b), (SELECT max(bin) FROM b) + 1)) AS bin) g LEFT JOIN b USING (bin)
""")
def q04_bins_dense(t: Tables) -> DataFrame:
    """Price bins from first to last with gaps kept as 0."""
    return facets.dense_bins(t.orders, F.floor(F.expr(_FINE) / 25), 1)


@query("SELECT CAST(year(o_orderdate) // 10 * 10 AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def q05_bins_sparse(t: Tables) -> DataFrame:
    """Decades that have rows."""
    return facets.sparse_bins(t.orders, F.year("o_orderdate"))


@query("""
SELECT CAST(row_number() OVER (ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS INTEGER) AS place, o_orderkey, CAST(o_orderdate AS VARCHAR)[:10] AS o_orderdate, o_orderpriority, true AS more
FROM (SELECT * FROM orders WHERE (o_orderdate, o_orderpriority, o_orderkey) > (TIMESTAMP '1997-05-28', '2-HIGH', 100) ORDER BY o_orderdate, o_orderpriority, o_orderkey LIMIT 50)
""")
def q06_keyset_next_page(t: Tables) -> DataFrame:
    """The page after a cursor, without an offset or a count."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = t.orders.where("o_orderdate >= timestamp_ntz '1997-05-28'")  # the cursor's first key, for the scan
    page = facets.keyset_page(rows, [day, F.col("o_orderpriority"), F.col("o_orderkey")], 50, ["1997-05-28", "2-HIGH", 100])
    return page.select("place", "o_orderkey", day.alias("o_orderdate"), "o_orderpriority", "more")


@query("""
SELECT o_orderkey, lag(o_orderkey) OVER w AS previous, lead(o_orderkey) OVER w AS following FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)
""")
def q07_adjacent_rows(t: Tables) -> DataFrame:
    """Each row's neighbours in its group's total order."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("previous"), F.lead("o_orderkey").over(w).alias("following"))


@query(f"""
SELECT doc_id, source FROM documents
WHERE list_bool_or(list_transform(regexp_split_to_array({text.fold_sql("text")}, '[^a-z0-9]+'), lambda w: starts_with(w, 'verein')))
  AND list_bool_or(list_transform(regexp_split_to_array({text.fold_sql("text")}, '[^a-z0-9]+'), lambda w: starts_with(w, 'uber')))
""")
def q08_prefix_token_search(t: Tables) -> DataFrame:
    """Documents in which every query token starts a word, accents folded."""
    words = text.tokens(F.col("text"))
    return t.documents.where(text.matches_prefixes(words, text.query_tokens("Verein über"))).select("doc_id", "source")


@query(f"SELECT doc_id FROM documents WHERE contains({text.fold_sql('text')}, 'etre') AND contains({text.fold_sql('text')}, 'eaux')")
def q09_folded_contains(t: Tables) -> DataFrame:
    """Documents whose folded text contains every term."""
    return t.documents.where(text.contains_all(F.col("text"), ["etre", "eaux"])).select("doc_id")


_TRI = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array({0}, '[^a-z0-9]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda k: substring('  ' || w || ' ', k, 3)))))"


@query(f"""
WITH names AS (SELECT DISTINCT p_name FROM part), s AS (SELECT p_name, CAST(len(list_intersect({_TRI.format("'smal wigdet'")}, {_TRI.format("lower(p_name)")})) AS DOUBLE) / len({_TRI.format("'smal wigdet'")}) AS share FROM names)
SELECT p_name, round(share, 6) AS share FROM s WHERE share >= 0.4
""")
def q10_trigram_search(t: Tables) -> DataFrame:
    """Names that share at least 0.4 of a misspelt query's trigrams."""
    share = text.trigram_share(F.lit("Smal wigdet"), F.col("p_name"))
    return t.part.select("p_name").distinct().withColumn("share", share).where("share >= 0.4").select("p_name", F.round("share", 6).alias("share"))


#: Names as they are printed: with a generic word, an article, a short form.
_FRONTS = ("", "Rue ", "Quai de la ", "R. ", "Vge de ", "Đại Lộ ")
_PRINTED = "[" + ", ".join(f"'{x}'" for x in _FRONTS) + "][CAST(p_partkey % 6 AS INTEGER) + 1] || p_name"
_KEY = f"nullif(trim(regexp_replace({text.fold_sql(_PRINTED)}, '[^a-z0-9]+', ' ', 'g')), '')"
_CUT = f"regexp_replace(regexp_replace({_KEY}, '^(({'|'.join(text.GENERICS)}) )+', ''), ' ({'|'.join(text.ARTICLES)})$', '')"
_CORE = f"CASE WHEN length({_CUT}) >= 4 THEN {_CUT} ELSE {_KEY} END"


def printed(key: str = "p_partkey", name: str = "p_name") -> Column:
    return F.concat(F.get(F.array(*map(F.lit, _FRONTS)), (F.col(key) % len(_FRONTS)).cast("int")), F.col(name))


@query(f"""
WITH keyed AS (SELECT {_CORE} AS key, * FROM part), c AS (SELECT key, p_name, count(*) AS n FROM keyed GROUP BY 1, 2),
head AS (SELECT key, p_name FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, p_name) = 1)
SELECT key, head.p_name AS p_name, string_agg(DISTINCT k.p_name, '|' ORDER BY k.p_name) AS variants, count(*) AS n, min(p_size) AS first, max(p_size) AS last, count(DISTINCT p_brand) AS groups
FROM keyed k JOIN head USING (key) WHERE length(key) >= 2 GROUP BY key, head.p_name
""")
def q11_place_key_groups(t: Tables) -> DataFrame:
    """A gazetteer: one row for each core key with its most frequent spelling, spellings, span and groups."""
    key = text.core_key(printed())
    return rollup.gazetteer(t.part, F.regexp_replace(key, "^$", ""), "p_name", "p_size", "p_brand")


@query(f"""
WITH keyed AS (SELECT {_CORE} AS key, p_partkey, p_name, p_retailprice FROM part)
SELECT key, p_partkey, p_name, count(*) OVER (PARTITION BY key) - 1 AS others FROM keyed QUALIFY row_number() OVER (PARTITION BY key ORDER BY p_retailprice DESC, p_partkey) = 1
""")
def q12_core_key_collapse(t: Tables) -> DataFrame:
    """The best row of each core key, with the number of the others."""
    key = text.core_key(printed())
    return rank.first_of_group(t.part.withColumn("key", key), ["key"], [F.desc("p_retailprice"), F.col("p_partkey")]).select("key", "p_partkey", "p_name", "others")


@query(f"""
WITH w AS (SELECT doc_id, lang, unnest(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}]+')) AS word FROM documents),
k AS (SELECT *, {text.fold_sql("word")} AS key FROM w WHERE word <> ''),
c AS (SELECT key, word, count(*) AS n FROM k GROUP BY 1, 2),
head AS (SELECT key, word FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY n DESC, length(word) DESC, word) = 1)
SELECT key, head.word, count(*) AS n, count(DISTINCT doc_id) AS n_docs, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM k JOIN head USING (key) GROUP BY key, head.word
""")
def q13_dictionary_build(t: Tables) -> DataFrame:
    """Words of all texts by folded key: headword, count, documents, languages."""
    words = t.documents.select("doc_id", "lang", F.explode(F.split("text", "[^\\p{L}]+")).alias("word")).where("word <> ''")
    # Counted per word, document and language first; only then is a word folded.
    counted = words.groupBy("word", "doc_id", "lang").agg(F.count("*").alias("n")).withColumn("key", text.fold(F.col("word")))
    spellings = counted.groupBy("key", "word").agg(F.sum("n").alias("n"))
    heads = spellings.groupBy("key").agg(F.min(F.struct(F.negative("n").alias("n"), F.negative(F.length("word")).alias("l"), "word")).alias("h")).select("key", "h.word")
    # The spellings of a document are few, so it is counted once per key without a set of documents.
    per_doc = counted.groupBy("key", "doc_id").agg(F.sum("n").alias("n"), F.collect_set("lang").alias("langs"))
    totals = per_doc.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("n_docs"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("langs")))), ",").alias("langs"))
    return totals.join(heads, "key").select("key", "word", "n", "n_docs", "langs")
