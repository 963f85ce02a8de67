"""Aggregates and intervals as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def axial_mean(angle: Column) -> Column:
    """Mean of angles with period 180, in (-90, 90]."""
    twice = F.radians(2 * angle)
    return F.degrees(F.atan2(F.sum(F.sin(twice)), F.sum(F.cos(twice)))) / 2


def percentiles(value: Column, points: tuple[int, ...] = (10, 25, 50, 75, 90, 99)) -> Column:
    """Interpolated percentiles as one array: all points from one buffer of distinct values and their counts."""
    return F.percentile(value, F.array(*(F.lit(p / 100) for p in points)))


def rmse(difference: Column) -> Column:
    """Root of the mean square."""
    return F.sqrt(F.avg(difference * difference))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval of k out of n; null for n = 0."""
    p = F.try_divide(k.cast("double"), n)
    middle, half = p + z * z / (2 * n), z * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(z * z), 4 * n * n))
    scale = 1 + F.try_divide(F.lit(z * z), n)
    return (middle - half) / scale, (middle + half) / scale


def f_measures(tp: Column, predicted: Column, actual: Column, digits: int = 4) -> dict[str, Column]:
    """Precision, recall and F1, rounded; 0 where nothing was predicted or is there."""
    p = F.coalesce(F.try_divide(tp.cast("double"), predicted), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), actual), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return {"precision": F.round(p, digits), "recall": F.round(r, digits), "f1": F.round(f, digits)}


def linear_fit(y: Column, x1: Column, x2: Column) -> list[Column]:
    """Sums for y = a + b x1 + c x2: one pass, whatever the number of rows."""
    names = {"n": F.lit(1.0), "s1": x1, "s2": x2, "sy": y, "s11": x1 * x1, "s12": x1 * x2, "s22": x2 * x2, "s1y": x1 * y, "s2y": x2 * y}
    return [F.sum(v).alias(k) for k, v in names.items()]


def solve_fit() -> dict[str, Column]:
    """Coefficients from the sums of linear_fit, by centred normal equations."""
    c = F.col
    c11, c12, c22 = (c(f"s{a}{b}") - c(f"s{a}") * c(f"s{b}") / c("n") for a, b in ((1, 1), (1, 2), (2, 2)))
    c1y, c2y = (c(f"s{a}y") - c(f"s{a}") * c("sy") / c("n") for a in (1, 2))
    det = c11 * c22 - c12 * c12
    b1, b2 = F.try_divide(c1y * c22 - c2y * c12, det), F.try_divide(c2y * c11 - c1y * c12, det)
    return {"b1": b1, "b2": b2, "b0": (c("sy") - b1 * c("s1") - b2 * c("s2")) / c("n")}
