"""Faceted search over the whole result: disjunctive counts, choices, bins, keyset pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_YEAR = 2147483648


def any_of(column: Column, values: list) -> Column:
    """Any of the values; an empty selection passes all."""
    return column.isin(values) if values else F.lit(True)


def in_range(column: Column, low=None, high=None) -> Column:
    """Inclusive range with open ends; with any bound, null never passes."""
    out = F.lit(True)
    if low is not None:
        out = out & F.coalesce(column >= low, F.lit(False))
    if high is not None:
        out = out & F.coalesce(column <= high, F.lit(False))
    return out


def visible(df: DataFrame, status: str, staff: bool | None) -> DataFrame:
    """The public sees published rows, staff drafts too; anything but True is not staff."""
    return df.where(F.col(status).isin(["public", "featured", *(["draft"] if staff is True else [])]))


def tested(df: DataFrame, filters: dict[str, Column]) -> DataFrame:
    """Adds `failed`, the names of the filters that a row doesn't pass; null doesn't pass."""
    return df.withColumn("failed", F.array_compact(F.array(*(F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in filters.items()), F.lit(None).cast("string"))))


def matched(df: DataFrame) -> DataFrame:
    return df.where(F.size("failed") == 0).drop("failed")


def facet_counts(df: DataFrame, dims: dict[str, Column], every: bool = False) -> DataFrame:
    """(dim, value, n): each dimension counts the rows that pass all other filters.

    Takes the output of tested(); array dimensions count each value.  Null and
    empty values are left out.  One pass and one shuffle for all dimensions,
    with partial sums.  `every` counts regardless of filters (the choices).
    """
    entries = []
    for name, column in dims.items():
        passes = F.lit(True) if every else F.size(F.array_except("failed", F.array(F.lit(name)))) == 0
        entry = F.when(passes, F.struct(F.lit(name).alias("dim"), column.cast("string").alias("value")))
        entries.append(entry)
    exploded = df.select(F.explode(F.array(*entries)).alias("e")).select("e.dim", "e.value")
    return exploded.where("value <> ''").groupBy("dim", "value").agg(F.count("*").alias("n"))


def sparse_bins(df: DataFrame, value: Column, width: int = 10) -> DataFrame:
    """(bin, n) of the bins that have rows."""
    start = (F.floor(value / width) * width).cast("long")
    return df.where(value.isNotNull()).groupBy(start.alias("bin")).agg(F.count("*").alias("n"))


def dense_bins(df: DataFrame, value: Column, width: int = 10) -> DataFrame:
    """(bin, n) from the first to the last bin, gaps as 0."""
    bins = sparse_bins(df, value, width)
    ends = bins.agg(F.min("bin").alias("low"), F.max("bin").alias("high")).where("low IS NOT NULL")
    every = ends.select(F.explode(F.sequence("low", "high", F.lit(width).cast("long"))).alias("bin"))
    return every.join(bins, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def after(keys: list[Column], cursor: list) -> Column:
    """Whether a row's keys come after the cursor's, key by key; keys must not be null."""
    out = F.lit(False)
    for k in range(len(keys)):
        same = reduce(lambda a, b: a & b, [keys[j] == F.lit(cursor[j]) for j in range(k)], F.lit(True))
        out = out | (same & (keys[k] > F.lit(cursor[k])))
    return out


def keyset_page(df: DataFrame, keys: list[Column], limit: int, cursor: list | None = None, most: int = 100) -> DataFrame:
    """The next `limit` rows after the cursor in a total order, and `more`: whether any follow.

    One row more than the page is read, so no count is needed; Spark keeps the
    first rows of each task only.
    """
    limit = max(1, min(limit, most))
    rows = df if cursor is None else df.where(after(keys, cursor))
    names = [f"_k{k}" for k in range(len(keys))]
    page = rows.withColumns(dict(zip(names, keys, strict=True))).orderBy(*names).limit(limit + 1)
    numbered = page.withColumn("_all", F.count("*").over(_whole())).withColumn("_n", F.row_number().over(_whole().orderBy(*names)))
    return numbered.where(F.col("_n") <= limit).withColumn("more", F.col("_all") > limit).withColumnRenamed("_n", "place").drop("_all", *names)


def _whole():
    """Only for pages: at most limit + 1 rows."""
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))
