"""Data-quality rules: each finding is a row (level, check, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finding(level: str, check: str, subject: Column, detail: Column) -> list[Column]:
    return [F.lit(level).alias("level"), F.lit(check).alias("check"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail")]


def rule(df: DataFrame, level: str, check: str, bad: Column, subject: Column, detail: Column) -> DataFrame:
    """A finding for every row for which `bad` holds."""
    return df.where(F.coalesce(bad, F.lit(False))).select(*_finding(level, check, subject, detail))


def dangling(df: DataFrame, key: str, other: DataFrame, other_key: str, level: str, check: str) -> DataFrame:
    """A finding for every non-null key that the other table lacks."""
    keys = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    missing = keys.join(other.select(F.col(other_key).alias("_key")), "_key", "left_anti")
    return missing.select(*_finding(level, check, F.col("_key"), F.concat(F.col("_n").cast("string"), F.lit(" rows"))))


def duplicated(df: DataFrame, keys: list[str], level: str, check: str, least: int = 2) -> DataFrame:
    """A finding for every key that `least` rows or more share."""
    groups = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    return groups.select(*_finding(level, check, F.concat_ws("|", *(F.col(k).cast("string") for k in keys)), F.col("_n")))


def findings(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reasons(tests: list[tuple[str, Column]]) -> Column:
    """Names of the tests that hold, in order, joined by commas; null for none."""
    return F.nullif(F.concat_ws(",", *(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests)), F.lit(""))


def multiset_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., in_old, in_new, change) per distinct key: equal keys pair up one by one, the surplus was added or removed."""
    a = old.groupBy(*keys).agg(F.count("*").alias("in_old"))
    b = new.groupBy(*keys).agg(F.count("*").alias("in_new"))
    both = a.join(b, keys, "full").select(*keys, F.coalesce("in_old", F.lit(0)).cast("long").alias("in_old"), F.coalesce("in_new", F.lit(0)).cast("long").alias("in_new"))
    change = F.when(F.col("in_old") == 0, "new").when(F.col("in_new") == 0, "missing").when(F.col("in_old") != F.col("in_new"), "drifted").otherwise("in sync")
    return both.withColumn("change", change)


def index_gaps(df: DataFrame, keys: list[str], number: Column) -> DataFrame:
    """The numbers between each group's first and last that it lacks."""
    have = df.select(*keys, number.alias("number")).where("number IS NOT NULL").distinct()
    every = have.groupBy(*keys).agg(F.min("number").alias("low"), F.max("number").alias("high")).select(*keys, F.explode(F.sequence("low", "high")).alias("number"))
    return every.join(have, [*keys, "number"], "left_anti")
