"""Scores, nearest rows, thinning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rule_score(rules: list[tuple[str, Column, int]]) -> tuple[Column, Column]:
    """Additive score, and the first rule's name that holds."""
    score, category = F.lit(0), F.lit(None).cast("string")
    for name, test, points in reversed(rules):
        score = score + F.when(test, points).otherwise(0)
        category = F.when(test, F.lit(name)).otherwise(category)
    return score, category


def score_bucket(score: Column, cuts: list[tuple[int, str]], none: str) -> Column:
    """The first cut (highest first) that the score reaches."""
    out = F.lit(none)
    for least, name in sorted(cuts):
        out = F.when(score >= least, F.lit(name)).otherwise(out)
    return out


def nearest_each_side(df: DataFrame, keys: list[str], value: str, target: Column, k: int, order: list[str]) -> DataFrame:
    """Up to k rows before, at and after the target in each group, nearest first: adds `side` and `place`."""
    side = F.when(F.col(value) < target, "before").when(F.col(value) > target, "after").otherwise("at")
    sided = df.where(F.col(value).isNotNull()).withColumn("side", side)
    # Before the target the largest value is the nearest, after it the smallest.
    nearness = [F.when(F.col("side") == "before", F.col(value)).desc_nulls_last(), F.col(value).asc(), *order]
    return sided.withColumn("place", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(*nearness))).where(F.col("place") <= k)


def best_in_bin(df: DataFrame, keys: list[str], rank: list[Column]) -> DataFrame:
    """One row of each bin: the first by rank."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*rank))).where("_n = 1").drop("_n")


def thin(df: DataFrame, groups: list[str], order: list[str], room: int) -> DataFrame:
    """Evenly spread rows, `room` of each group, ends included; smaller groups stay whole."""
    number = F.row_number().over(Window.partitionBy(*groups).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(*groups))
    numbered = df.withColumn("_k", number).withColumn("_n", n)
    if room == 1:
        return numbered.where("_k = 0").drop("_k", "_n")
    # Row k is kept if it is the rounded place of some slot i.
    slot = F.round(F.col("_k") * (room - 1) / (F.col("_n") - 1))
    place = F.round(slot * (F.col("_n") - 1) / (room - 1))
    return numbered.where((F.col("_n") <= room) | (F.col("_k") == place)).drop("_k", "_n")


def first_of_group(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each group with `others`, the number of the rest."""
    window = Window.partitionBy(*keys)
    return df.withColumn("_n", F.row_number().over(window.orderBy(*order))).withColumn("others", F.count("*").over(window) - 1).where("_n = 1").drop("_n")


def first_in_group(df: DataFrame, keys: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first n rows of each group; a rank limit lets Spark drop rows before the shuffle."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def slice_groups(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first n rows of each group with `place` and the group's full count."""
    window = Window.partitionBy(*keys)
    return df.withColumn("place", F.row_number().over(window.orderBy(*order))).withColumn("full_count", F.count("*").over(window)).where(F.col("place") <= n)
