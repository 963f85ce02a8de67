"""Decisions in an order, each of which depends on earlier ones, as rounds of joins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import shared


def eliminated(duels: DataFrame) -> DataFrame:
    """(id, by): the rows that lose a duel, and the winner of the first one that they lose.

    `duels` has `winner`, `loser` and `place`, distinct values in the order in which one would go through the duels one by
    one; a duel only takes place if both are still there.  A duel stands once its winner has no open earlier duel to
    lose, and is void once its winner has lost an earlier one that stands.  Each round settles all duels of which
    either is known, so the rounds follow the longest chain of duels that hang on one another: a row that beats many
    others does so in one round.
    """
    left = shared.stored(duels.select("winner", "loser", "place"), "duels")
    empty = left.select(F.col("loser").alias("id"), F.col("winner").alias("by"), "place").limit(0)
    stands = [empty]
    while not left.isEmpty():
        losses = left.groupBy(F.col("loser").alias("id")).agg(F.min("place").alias("first"))
        dated = shared.stored(left.join(losses.hint("merge"), left["winner"] == losses["id"], "left").select("winner", "loser", "place", (F.coalesce(F.col("first") < F.col("place"), F.lit(False))).alias("open")), "duels")
        stands.append(dated.where("NOT open").select(F.col("loser").alias("id"), F.col("winner").alias("by"), "place"))
        lost = stands[-1].groupBy("id").agg(F.min("place").alias("lost"))
        rest = dated.where("open").join(lost.hint("merge"), F.col("winner") == F.col("id"), "left").where("lost IS NULL OR lost > place")
        left = shared.stored(rest.select("winner", "loser", "place"), "duels")
    return reduce(DataFrame.union, stands).groupBy("id").agg(F.min_by("by", "place").alias("by"))


#: Shares of the rows, by their ids, after which those that are gone are left out.
BATCHES = (0.005, 0.03, 0.15)


def eliminated_rows(rows: DataFrame, id_: str, duels_of: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(id, by): eliminated() over all duels of rows in the order of the smaller and then the larger id, without listing them all.

    `duels_of(first, later)` gives the duels, as eliminated() takes them, of pairs whose smaller id is in `first` and whose
    larger one is in `later`.  Rows go in batches by id: what the duels of a batch eliminate meets nobody in later
    ones, so a batch's duels are those of rows that are still there.  The order is that of a loop, wherever batches end.
    """
    ends = rows.agg(F.percentile_approx(id_, [*BATCHES], 10_000)).first()[0] or []
    left, found = rows, []
    for high in [*ends, None]:
        first = left if high is None else left.where(F.col(id_) <= high)
        found.append(shared.stored(eliminated(duels_of(first, left)), "duels-lost"))
        if high is not None:
            gone = found[-1].select(F.col("id").alias(id_)).hint("merge")
            left = shared.stored(left.where(F.col(id_) > high).join(gone, id_, "left_anti"), "duels-left")
    return reduce(DataFrame.unionByName, found)


def first_fit(rows: DataFrame, id_: str, close: DataFrame) -> DataFrame:
    """(id, leader): going through the rows by their ids, each joins the first leader that it is close to, or leads itself.

    `close` has pairs (first, later) of close rows with first < later.  Who joins a leader is none.
    """
    duels = close.where("first < later").select(F.col("first").alias("winner"), F.col("later").alias("loser"), F.struct("first", "later").alias("place")).distinct()
    joined = eliminated(duels).select(F.col("id").alias("_id"), "by")
    return rows.join(joined.hint("merge"), F.col(id_) == F.col("_id"), "left").select(F.col(id_), F.coalesce("by", id_).alias("leader"))
