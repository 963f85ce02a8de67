"""Entity resolution: blocked pairs, components, survivors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import shared


def blocked_pairs(df: DataFrame, block: list[str], id_: str, columns: list[str]) -> DataFrame:
    """Pairs a < b of rows with equal blocking keys: columns a_<c> and b_<c>.

    The block must be selective; hot blocks are split by Spark's skew join.
    """
    a = df.select(*block, *(F.col(c).alias(f"a_{c}") for c in [id_, *columns]))
    b = df.select(*block, *(F.col(c).alias(f"b_{c}") for c in [id_, *columns]))
    return a.join(b, block).where(F.col(f"a_{id_}") < F.col(f"b_{id_}"))


def stars(df: DataFrame, keys: list[str], step: str, id_: str) -> DataFrame:
    """Edges (a, b) that join rows of equal keys whose `step` is equal or differs by one: as many as there are rows and steps, not pairs."""
    heads = df.groupBy(*keys, step).agg(F.min(id_).alias("a"))
    own = df.select(*keys, step, F.col(id_).alias("b")).join(heads, [*keys, step]).select("a", "b")
    after = heads.select(*keys, (F.col(step) - 1).alias(step), F.col("a").alias("b"))
    return own.union(heads.join(after, [*keys, step]).select("a", "b"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each connected component of the edges.

    Every node points to the smallest of itself and its neighbours, pointers are doubled up to their roots, and the
    edges between roots make the next graph.  A root to which no neighbour points has a smaller neighbour there, so
    two rounds at least halve the nodes, and the rounds don't follow the diameter.  Steps are cut from their lineage
    by tables in the checkpoint folder.  Those tables are far larger than their files, so no join sends one to every task.
    """
    rest = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    rest = shared.stored(rest.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    rounds: list[DataFrame] = []
    while not rounds or not rest.isEmpty():
        roots = shared.stored(_smallest_neighbours(rest))
        while not roots.where("moves").isEmpty():
            up = roots.select(F.col("node").alias("via"), F.col("root").alias("next"))
            roots = shared.stored(roots.join(up.hint("merge"), F.col("root") == F.col("via")).select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moves")))
        rounds.append(roots)
        near, far = (roots.select(F.col("node").alias(f"_{c}"), F.col("root").alias(f"{c}_root")) for c in "uv")
        between = rest.join(near.hint("merge"), F.col("u") == F.col("_u")).join(far.hint("merge"), F.col("v") == F.col("_v")).where("u_root <> v_root")
        rest = shared.stored(between.select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v")).distinct())
    labels = rounds[-1].select("node", F.col("root").alias("label"))
    for roots in reversed(rounds[:-1]):
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("top"))
        labels = shared.stored(roots.join(up.hint("merge"), F.col("root") == F.col("via"), "left").select("node", F.coalesce("top", "root").alias("label")))
    return labels


def _smallest_neighbours(edges: DataFrame) -> DataFrame:
    """(node, root, moves): the smallest of each node and its neighbours, and whether that is another node."""
    first = edges.union(edges.select("v", "u")).groupBy("u").agg(F.min("v").alias("near"))
    return first.select(F.col("u").alias("node"), F.least("u", "near").alias("root"), (F.col("near") < F.col("u")).alias("moves"))


def survivors(df: DataFrame, labels: DataFrame, id_: str, better: list[Column]) -> DataFrame:
    """One row of each component, the first by `better` (ties by id), and all rows outside components."""
    from pyspark.sql import Window

    own = labels.select(F.col("node").alias(id_), "label")
    rows = df.join(own, id_, "left").withColumn("label", F.coalesce("label", F.col(id_)))
    w = Window.partitionBy("label")
    return rows.withColumn("_n", F.row_number().over(w.orderBy(*better, id_))).withColumn("members", F.count("*").over(w)).where("_n = 1").drop("_n")


def nearest_links(occurrences: DataFrame, sheet: str, name: str, id_: str, reach: float, x: str = "x", y: str = "y") -> DataFrame:
    """(a, b, distance): for each name on a sheet and the next one, the nearest pair of its occurrences, if within `reach`.

    Occurrences meet in grid cells four times as wide as the reach, so a name that stands everywhere meets its
    surroundings only.  Of equal distances the smaller ids win.
    """
    size = 4 * reach
    left = occurrences.select(name, F.col(sheet).alias("sheet"), F.col(id_).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), geo.cell(F.col(x), size).alias("cx"), geo.cell(F.col(y), size).alias("cy"))
    right = occurrences.select(name, (F.col(sheet) - 1).alias("sheet"), F.col(id_).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"))
    for c in "xy":
        right = right.withColumn(f"c{c}", F.explode(F.sequence(geo.cell(F.col(f"b{c}") - reach, size), geo.cell(F.col(f"b{c}") + reach, size))))
    # The root of a sum of squares is the same for the same squares, which hypot() doesn't promise.
    distance = F.sqrt((F.col("ax") - F.col("bx")) * (F.col("ax") - F.col("bx")) + (F.col("ay") - F.col("by")) * (F.col("ay") - F.col("by")))
    met = left.join(right.hint("merge"), [name, "sheet", "cx", "cy"]).withColumn("distance", distance).where(F.col("distance") <= reach)
    best = met.groupBy(name, "sheet").agg(F.min(F.struct("distance", "a", "b")).alias("l"))
    return best.select("l.a", "l.b", "l.distance")
