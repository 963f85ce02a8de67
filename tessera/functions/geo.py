"""Planar and spherical geometry as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8


def haversine(lng_a: Column, lat_a: Column, lng_b: Column, lat_b: Column, radius: float = EARTH_M) -> Column:
    """Great-circle distance in metres."""
    dlat, dlng = F.radians(lat_b - lat_a), F.radians(lng_b - lng_a)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(F.sin(dlng / 2), 2)
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bearing(lng_a: Column, lat_a: Column, lng_b: Column, lat_b: Column) -> Column:
    """Initial bearing, 0 to 360 degrees."""
    a, b, d = F.radians(lat_a), F.radians(lat_b), F.radians(lng_b - lng_a)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))), F.lit(360.0))


def compass(degrees: Column) -> Column:
    """One of eight directions."""
    return F.get(F.array(*map(F.lit, ("N", "NE", "E", "SE", "S", "SW", "W", "NW"))), F.pmod(F.round(degrees / 45), F.lit(8.0)).cast("int"))


def axial_difference(a: Column, b: Column) -> Column:
    """Difference of two undirected angles, 0 to 90 degrees."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180 - d)


def box_contains(w: Column, s: Column, e: Column, n: Column, lng: Column, lat: Column) -> Column:
    """Closed on all four edges; a box whose edges are out of order contains nothing."""
    return (w <= e) & (s <= n) & lng.between(w, e) & lat.between(s, n)


def box_iou(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Intersection over union of boxes given by corner and size; 0 without area."""
    w = F.greatest(F.lit(0.0), F.least(ax + aw, bx + bw) - F.greatest(ax, bx))
    h = F.greatest(F.lit(0.0), F.least(ay + ah, by + bh) - F.greatest(ay, by))
    both = w * h
    return F.coalesce(F.try_divide(both, aw * ah + bw * bh - both), F.lit(0.0))


def edges(ring: Column) -> Column:
    """Pairs of neighbouring vertices, the last with the first."""
    return F.arrays_zip(ring.alias("p"), F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)).alias("q"))


def signed_area(ring: Column) -> Column:
    """Area of a ring of (x, y), open or closed, positive for counter-clockwise."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + e["p"]["x"] * e["q"]["y"] - e["q"]["x"] * e["p"]["y"]) / 2


def ring_area(ring: Column) -> Column:
    """Area of a ring of (x, y), open or closed."""
    return F.abs(signed_area(ring))


def in_ring(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point is inside a ring, by the number of edges that a ray to the right crosses."""
    def crosses(e: Column) -> Column:
        p, q = e["p"], e["q"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]) + p["x"])

    return F.pmod(F.aggregate(edges(ring), F.lit(0), lambda n, e: n + F.coalesce(crosses(e), F.lit(False)).cast("int")), F.lit(2)) == 1


def cell(value: Column, size: float) -> Column:
    """Number of the grid cell that holds a coordinate."""
    return F.floor(value / size).cast("long")


def plane_metres(lng_a: Column, lat_a: Column, lng_b: Column, lat_b: Column, per_lng: float = 111_320.0, per_lat: float = 110_574.0) -> Column:
    """Distance in metres on a plane: good for short ways, and cheaper than the sphere."""
    return F.sqrt(F.pow((lng_b - lng_a) * per_lng * F.cos(F.radians(lat_a)), 2) + F.pow((lat_b - lat_a) * per_lat, 2))


def turned_box(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """Corners of a box around a centre, turned by an angle."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))

    def corner(a: int, b: int) -> Column:
        x, y = w * (a / 2), h * (b / 2)
        return F.struct((cx + x * cos - y * sin).alias("x"), (cy + x * sin + y * cos).alias("y"))

    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))


def ring_length(ring: Column) -> Column:
    """Length of a closed ring's edges."""
    return F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + F.sqrt(F.pow(e["p"]["x"] - e["q"]["x"], 2) + F.pow(e["p"]["y"] - e["q"]["y"], 2)))


def compactness(ring: Column) -> Column:
    """4 pi area / length squared: 1 for a circle; null without length."""
    return F.try_divide(4 * F.pi() * ring_area(ring), F.pow(ring_length(ring), 2))


def _turn(o: Column, a: Column, b: Column) -> Column:
    """Positive where o, a, b turn to the left."""
    return (a["x"] - o["x"]) * (b["y"] - o["y"]) - (a["y"] - o["y"]) * (b["x"] - o["x"])


def hull(points: Column) -> Column:
    """Convex hull of an array of (x, y), counter-clockwise from the leftmost point; collinear points are left out.

    Two chains over the sorted points. A new point takes off the chain's end all
    points after the last one at which the chain still turns to the left.
    """
    distinct = F.array_sort(F.array_distinct(points))

    def add(chain: Column, p: Column) -> Column:
        bends = F.filter(F.sequence(F.lit(1), F.size(chain)), lambda k: (k == 1) | (_turn(F.get(chain, k - 2), F.get(chain, k - 1), p) > 0))
        return F.concat(F.slice(chain, F.lit(1), F.coalesce(F.array_max(bends), F.lit(0))), F.array(p))

    def half(ordered: Column) -> Column:
        chain = F.aggregate(F.slice(ordered, F.lit(2), F.size(ordered)), F.slice(ordered, F.lit(1), F.lit(1)), add)
        return F.slice(chain, F.lit(1), F.size(chain) - 1)

    return F.get(F.transform(F.array(distinct), lambda d: F.when(F.size(d) < 3, d).otherwise(F.concat(half(d), half(F.reverse(d))))), F.lit(0))


def least_box_area(points: Column) -> Column:
    """Area of the smallest rectangle at any angle around the points; one of its sides lies on the hull."""
    outline = hull(points)

    def box(ring: Column, e: Column) -> Column:
        dx, dy = e["q"]["x"] - e["p"]["x"], e["q"]["y"] - e["p"]["y"]
        along, across = (F.transform(ring, f) for f in (lambda v: v["x"] * dx + v["y"] * dy, lambda v: v["y"] * dx - v["x"] * dy))
        return F.try_divide((F.array_max(along) - F.array_min(along)) * (F.array_max(across) - F.array_min(across)), dx * dx + dy * dy)

    return F.get(F.transform(F.array(outline), lambda ring: F.array_min(F.transform(edges(ring), lambda e: box(ring, e)))), F.lit(0))


def convexity(ring: Column) -> Column:
    """Share of the convex hull's area that a ring fills; null without one."""
    return F.try_divide(ring_area(ring), ring_area(hull(ring)))


def rectangularity(ring: Column) -> Column:
    """Share of the smallest rectangle around a ring that it fills; null without one."""
    return F.try_divide(ring_area(ring), least_box_area(ring))
