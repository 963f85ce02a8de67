"""Grouped summaries: gazetteers, dictionaries, coverage, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def most_frequent(df: DataFrame, keys: list[str], value: str, longest: bool = False) -> DataFrame:
    """The most frequent value of each group as `<value>`; of ties the longest, if asked, and then the first in order.

    Counted in two steps, so that a large group is spread over its values first.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    order = [F.negative("_n").alias("n")] + ([F.negative(F.length(value)).alias("length")] if longest else []) + [F.col(value).alias("value")]
    return counted.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_best")).select(*keys, F.col("_best.value").alias(value))


def gazetteer(df: DataFrame, key: Column, name: str, span: str, group: str, least: int = 2) -> DataFrame:
    """One row for each key: most frequent spelling, spellings, rows, span, distinct groups."""
    keyed = df.withColumn("key", key).where(F.length("key") >= least)
    head = most_frequent(keyed, ["key"], name)
    rest = keyed.groupBy("key").agg(
        F.array_join(F.array_sort(F.collect_set(name)), "|").alias("variants"),
        F.count("*").alias("n"),
        F.min(span).alias("first"),
        F.max(span).alias("last"),
        F.count_distinct(group).alias("groups"),
    )
    return head.join(rest, "key")


def tally(df: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    """(value, n); null and blank values are left out, or counted under `blank`."""
    value = F.nullif(F.trim(F.col(column)), F.lit(""))
    if blank is not None:
        value = F.coalesce(value, F.lit(blank))
    return df.withColumn("value", value).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))


def flags_by(df: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """For each group, whether any row has each flag."""
    return df.groupBy(*keys).agg(*(F.coalesce(F.max(test), F.lit(False)).alias(name) for name, test in flags.items()))


def distinct_where(tests: dict[str, tuple[Column, str]]) -> list[Column]:
    """count(distinct column) of the rows that pass a test, for each name."""
    return [F.count_distinct(F.when(test, F.col(column))).alias(name) for name, (test, column) in tests.items()]
