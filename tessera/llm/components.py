"""Connected components of an edge table, by contraction: the rounds grow with the logarithm of the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import dropped, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b): label is its component's smallest node.

    In each round every node points to the smallest of itself and its neighbours, pointers are doubled until they end
    at roots, and the edges between roots are the next round's.  A root that none of its neighbours points to has a
    smaller neighbour in the next round, so two rounds at least halve the nodes, whatever the diameter is.  Every step
    is written to the shared folder; the driver only learns whether edges are left.
    """
    rest = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    rounds: list[DataFrame] = []
    while not rounds or not rest.isEmpty():
        pointers = stored(_pointers(rest), "pointers")
        while not pointers.where("moves").isEmpty():
            up = pointers.select(F.col("node").alias("via"), F.col("goes").alias("next"))
            doubled = pointers.join(up, pointers["goes"] == up["via"]).select("node", F.col("next").alias("goes"), (F.col("next") != F.col("goes")).alias("moves"))
            doubled = stored(doubled, "pointers")
            dropped(pointers)
            pointers = doubled
        rounds.append(pointers)
        one, two = (pointers.select(F.col("node").alias(f"_{c}"), F.col("goes").alias(f"{c}_root")) for c in "ab")
        roots = rest.join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b")).where("a_root <> b_root")
        between = stored(roots.select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct(), "edges")
        dropped(rest)
        rest = between
    labels = rounds[-1].select("node", F.col("goes").alias("label"))
    for pointers in reversed(rounds[:-1]):
        up = labels.select(F.col("node").alias("via"), F.col("label").alias("top"))
        labels = stored(pointers.join(up, pointers["goes"] == up["via"], "left").select("node", F.coalesce("top", "goes").alias("label")), "labels")
    return labels


def _pointers(edges: DataFrame) -> DataFrame:
    """Where each node points, and whether what it points to may point on."""
    both = edges.union(edges.select("b", "a"))
    first = both.groupBy("a").agg(F.min("b").alias("near")).select("a", F.least("a", "near").alias("goes"))
    return first.select(F.col("a").alias("node"), "goes", (F.col("goes") != F.col("a")).alias("moves"))


def merged_components(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of connected_components() after further links: only the components that these join are worked on."""
    if labels is None:
        return connected_components(links)
    one, two = (labels.select(F.col("node").alias(f"_{c}"), F.col("label").alias(f"{c}_label")) for c in "ab")
    known = links.join(one, F.col("a") == F.col("_a"), "left").join(two, F.col("b") == F.col("_b"), "left")
    above = connected_components(known.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))
    up = above.select(F.col("node").alias("via"), F.col("label").alias("top"))
    moved = labels.join(up, labels["label"] == up["via"], "left").select("node", F.coalesce("top", "label").alias("label"))
    return stored(moved.unionByName(above.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
