"""Overlays against exact slabs in plain Python, and decisions in an order against loops that go through it."""

from __future__ import annotations

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.operators import order, overlay, resolve

SHAPE = "id long, g int, rings array<array<struct<x: double, y: double>>>"


def brute_ground(shapes, wanted) -> float:
    """Area of the points at which wanted(set of covering shapes) holds; exact."""
    edges = []
    for n, rings in enumerate(shapes):
        for ring in rings:
            points = [(Fraction(x), Fraction(y)) for x, y in ring]
            for p, q in zip(points, points[1:] + points[:1], strict=True):
                if p[0] != q[0]:
                    edges.append((n, *min(p, q), *max(p, q)))
    at = lambda e, x: e[2] + (e[4] - e[2]) * (x - e[1]) / (e[3] - e[1])
    cuts = {x for e in edges for x in (e[1], e[3])}
    for k, e in enumerate(edges):
        for f in edges[:k]:
            low, high = max(e[1], f[1]), min(e[3], f[3])
            if low < high and (at(e, low) - at(f, low)) * (at(e, high) - at(f, high)) < 0:
                d, d2 = at(e, low) - at(f, low), at(e, high) - at(f, high)
                cuts.add(low + (high - low) * d / (d - d2))
    cuts, total = sorted(cuts), Fraction(0)
    for low, high in zip(cuts, cuts[1:], strict=False):
        mid = (low + high) / 2
        rows = sorted((at(e, mid), e[0]) for e in edges if e[1] <= low and high <= e[3])
        inside: set[int] = set()
        for (y, n), (up, _) in zip(rows, rows[1:], strict=False):
            inside ^= {n}
            if wanted(inside):
                total += (up - y) * (high - low)
    return float(total)


def make_shapes(seed: int, n: int, span: float):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        x, y, r = rng.uniform(-span, span), rng.uniform(-span, span), rng.uniform(3, 12)
        turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(5, 9)))
        star = [(x + r * rng.uniform(0.6, 1) * math.cos(a), y + r * rng.uniform(0.6, 1) * math.sin(a)) for a in turns]
        rings = [star]
        if k % 3 == 0:
            rings = [[(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r)], [(x - r / 2, y), (x, y + r / 3), (x + r / 2, y - r / 4)]]
        if k % 2:
            rings = [ring[::-1] for ring in rings]
        out.append(rings)
    return out


def frame(spark, shapes, groups=None):
    closed = lambda ring: [*ring, ring[0]] if len(ring) % 2 else ring
    return spark.createDataFrame([(k, groups[k] if groups else 0, [closed(r) for r in s]) for k, s in enumerate(shapes)], SHAPE)


def test_shared_areas_equal_exact_ones(spark):
    one, two = make_shapes(1, 12, 20), make_shapes(2, 12, 20)
    a, b = frame(spark, one).withColumnRenamed("id", "a"), frame(spark, two).withColumnRenamed("id", "b")
    got = {(r["a"], r["b"]): r["shared"] for r in overlay.overlaps(a, b, "a", "b", 7.0).collect()}
    want = {(i, j): brute_ground([p, q], lambda c: len(c) == 2) for i, p in enumerate(one) for j, q in enumerate(two)}
    assert len(got) > 10 and set(got) >= {k for k, v in want.items() if v > 1e-6}
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in got)


@pytest.mark.parametrize("size", [5.0, 1000.0])
def test_union_counts_nothing_twice(spark, size):
    shapes = make_shapes(3, 14, 15)
    shapes += shapes[:4]
    groups = [k % 2 for k in range(len(shapes))]
    got = {r["g"]: r["area"] for r in overlay.union_areas(frame(spark, shapes, groups), ["g"], "id", size).collect()}
    for g in (0, 1):
        want = brute_ground([s for s, h in zip(shapes, groups, strict=True) if h == g], bool)
        assert got[g] == pytest.approx(want, rel=1e-9)


def test_two_equal_squares_count_twice_but_cover_once(spark):
    """A building of 0.001 degrees in a ground of 0.01: 11,000 to 13,500 square metres, a share of .008 to .012."""
    side_x, side_y = 0.001 * 111_320 * math.cos(math.radians(10.76)), 0.001 * 110_574
    square = [[(0.0, 0.0), (side_x, 0.0), (side_x, side_y), (0.0, side_y)]]
    half = [[(side_x / 2, 0.0), (1.5 * side_x, 0.0), (1.5 * side_x, side_y), (side_x / 2, side_y)]]
    area = lambda shapes: overlay.union_areas(frame(spark, shapes), ["g"], "id", 50.0).collect()
    once = area([square])[0]["area"]
    assert 11_000 < once < 13_500 and 0.008 < once / (100 * side_x * side_y) < 0.012
    assert area([square, square])[0]["area"] == pytest.approx(once) and area([square, half])[0]["area"] == pytest.approx(1.5 * once)
    assert area([]) == []


def test_eliminated_equals_a_loop(spark):
    rng = random.Random(8)
    for n, m in ((30, 60), (200, 700), (5, 0)):
        pairs = sorted({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        duels = [(i, j) if rng.random() < 0.6 else (j, i) for i, j in pairs]
        gone: dict[int, int] = {}
        for winner, loser in duels:
            if winner not in gone and loser not in gone:
                gone[loser] = winner
        rows = spark.createDataFrame([(w, v, k) for k, (w, v) in enumerate(duels)], "winner long, loser long, place long")
        assert {r["id"]: r["by"] for r in order.eliminated(rows).collect()} == gone


def test_first_fit_equals_a_loop(spark):
    rng = random.Random(9)
    points = [(k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(150)]
    leaders, want = [], {}
    for k, x, y in points:
        own = next((c for c, cx, cy in leaders if math.hypot(x - cx, y - cy) <= 12), None)
        want[k] = k if own is None else own
        if own is None:
            leaders.append((k, x, y))
    close = [(a, b) for a, ax, ay in points for b, bx, by in points if a < b and math.hypot(ax - bx, ay - by) <= 12]
    rows = spark.createDataFrame(points, "id long, x double, y double")
    got = order.first_fit(rows, "id", spark.createDataFrame(close, "first long, later long"))
    assert {r["id"]: r["leader"] for r in got.collect()} == want


def test_nearest_links(spark):
    rng = random.Random(10)
    rows = [(k, rng.randrange(4), f"n{rng.randrange(8)}", rng.uniform(0, 50), rng.uniform(-50, 0)) for k in range(120)]
    got = {(r["a"], r["b"]) for r in resolve.nearest_links(spark.createDataFrame(rows, "id long, sheet int, name string, x double, y double"), "sheet", "name", "id", 9.0).collect()}
    want = set()
    for sheet in range(3):
        for name in {r[2] for r in rows}:
            pairs = [(math.hypot(a[3] - b[3], a[4] - b[4]), a[0], b[0]) for a in rows for b in rows if a[1] == sheet and b[1] == sheet + 1 and a[2] == b[2] == name]
            if pairs and min(pairs)[0] <= 9:
                want.add(min(pairs)[1:])
    assert got == want and len(want) > 3


def test_no_two_nested_passes_over_rows(spark):
    """Candidates meet on cells: no nested loop in the plan of an overlay."""
    shapes = make_shapes(4, 6, 10)
    found = overlay.overlaps(frame(spark, shapes).withColumnRenamed("id", "a"), frame(spark, shapes).withColumnRenamed("id", "b"), "a", "b", 7.0)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert found.where(F.col("a") == F.col("b")).count() == 6
