"""Search for names that resemble a query, by word similarity over an inverted index of trigrams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text


def trigram_list(key: Column) -> Column:
    """Trigrams of a key's words in their order, repeats kept; a word has two blanks before and one after it."""
    padded = F.transform(F.filter(F.split(key, "[^\\p{L}\\p{N}]+"), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3)))))


def word_similarity(query: Column, grams: Column) -> Column:
    """The largest share of common to all trigrams of the query and any stretch of the other list; 0 without one.

    Both are arrays, the query's distinct. A best stretch begins and ends with a
    trigram of the query, so only those are tried.
    """
    hits = F.filter(F.sequence(F.lit(1), F.greatest(F.size(grams), F.lit(1))), lambda k: F.array_contains(query, F.get(grams, k - 1)))

    def share(first: Column, last: Column) -> Column:
        stretch = F.array_distinct(F.slice(grams, first, last - first + 1))
        both = F.size(F.array_intersect(query, stretch))
        return both / (F.size(query) + F.size(stretch) - both)

    best = F.transform(hits, lambda a: F.array_max(F.transform(F.filter(hits, lambda b: b >= a), lambda b: share(a, b))))
    return F.coalesce(F.array_max(best), F.lit(0.0))


def resembling(queries: DataFrame, rows: DataFrame, query: str, key: str, least: float = 0.5) -> DataFrame:
    """(query, key, similarity) of every distinct key whose word similarity to a distinct query is `least` (above 0) or more.

    A key that similar has at least that share of the query's trigrams, so it has
    one of the query's rarest `n - least * n + 1`: only those meet the index.
    Rows that repeat a key count once from the start. Null and empty queries and
    keys resemble nothing; other columns are not looked at.
    """
    asked = queries.select(F.col(query).alias("query")).distinct().withColumn("own", F.array_distinct(trigram_list(F.col("query")))).where(F.size("own") > 0)
    keys = rows.select(F.col(key).alias("key")).distinct().withColumn("grams", trigram_list(F.col("key"))).where(F.size("grams") > 0)
    index = keys.select("key", "grams", F.explode(F.array_distinct("grams")).alias("gram"))
    wanted = asked.select("query", "own", F.explode("own").alias("gram"))
    found = index.groupBy("gram").agg(F.count("*").alias("held"))
    rarest = Window.partitionBy("query").orderBy("held", "gram")
    needed = F.ceil(F.size("own") * F.lit(least) - 1e-9)
    prefixes = wanted.join(found, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0))).withColumn("place", F.row_number().over(rarest)).where(F.col("place") <= F.size("own") - needed + 1)
    # A pair is scored where its first prefix trigram in the query's order meets, so it needs no later distinct.
    own_prefix = prefixes.withColumn("before", F.collect_list("gram").over(rarest.rowsBetween(Window.unboundedPreceding, -1)))
    pairs = own_prefix.join(index, "gram").where(~F.arrays_overlap("before", "grams"))
    return pairs.select("query", "key", word_similarity(F.col("own"), F.col("grams")).alias("similarity")).where(F.col("similarity") >= least)


def best_per_key(queries: DataFrame, rows: DataFrame, query: str, label: str, sheet: str, order: list[Column], least: float = 0.5) -> DataFrame:
    """The first row, in the given order, of each sheet and folded label that resembles a query, with `asked` (the folded query) and `similarity`.

    The rows' best ones are taken before the queries meet them: a label that is
    printed a million times on a sheet is one row by then.
    """
    keyed = rows.withColumn("_similar_key", text.place_key(F.col(label)))
    columns = [F.col(c) for c in rows.columns]
    best = keyed.groupBy(sheet, "_similar_key").agg(F.min(F.struct(*(o.alias(f"_o{k}") for k, o in enumerate(order)), F.struct(*columns).alias("_row"))).alias("_best"))
    asked = queries.withColumn("_similar_query", text.fold(F.trim(F.col(query))))
    close = resembling(asked.where(F.length("_similar_query") >= 2), best, "_similar_query", "_similar_key", least)
    return close.join(best.select("_similar_key", "_best"), F.col("key") == F.col("_similar_key")).select(F.col("query").alias("asked"), "similarity", "_best._row.*")
