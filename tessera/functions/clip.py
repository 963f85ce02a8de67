"""Clipping of rings to boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _half_plane(ring: Column, axis: str, limit: Column, keep_above: bool) -> Column:
    """The part of a ring on one side of an axis-parallel line."""
    other = "y" if axis == "x" else "x"

    def inside(p: Column) -> Column:
        return p[axis] >= limit if keep_above else p[axis] <= limit

    def crossing(p: Column, q: Column) -> Column:
        share = F.try_divide(limit - p[axis], q[axis] - p[axis])
        along = p[other] + share * (q[other] - p[other])
        return F.struct((limit if axis == "x" else along).alias("x"), (along if axis == "x" else limit).alias("y"))

    def kept(q: Column, k: Column) -> Column:
        p = F.element_at(ring, F.when(k == 0, -1).otherwise(k))  # the vertex before
        entering = F.when(inside(p) != inside(q), F.array(crossing(p, q))).otherwise(F.array())
        return F.concat(entering, F.when(inside(q), F.array(F.struct(q["x"].alias("x"), q["y"].alias("y")))).otherwise(F.array()))

    return F.flatten(F.transform(ring, kept))


def clip_rings(df: DataFrame, ring: str = "ring", box: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1")) -> DataFrame:
    """`df` with each convex or simple ring (an array of x, y) cut to its row's box; an empty ring where nothing is left.

    A generator for each edge of the box keeps the cuts apart: as nested expressions every vertex would cut its ring anew.
    """
    x0, y0, x1, y1 = (F.col(c).cast("double") for c in box)
    out = df
    for axis, limit, above in (("x", x0, True), ("x", x1, False), ("y", y0, True), ("y", y1, False)):
        out = out.withColumn(ring, F.explode(F.array(_half_plane(F.col(ring), axis, limit, above))))
    return out
