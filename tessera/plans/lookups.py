"""Typed positions, measures of shapes, and names that resemble a query."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import coordinates, geo, text
from tessera.operators import similar
from tessera.plans.registry import Tables, query


def _typed(t: Tables) -> DataFrame:
    """Customers with a position as someone would type it: grid letters, UTM, decimals, minutes, or just a name."""
    k = F.col("c_custkey")
    zone = 48 + F.floor(k / 6) % 2
    e, n, a, b = 200_000 + k * 7919 % 600_000, 950_000 + k * 104_729 % 1_600_000, k * 7919 % 1_500_000, k * 104_729 % 1_200_000
    square = coordinates.square_of(e, n, zone)
    digits = lambda v, unit, width: F.lpad(F.floor(v % 100_000 / unit).cast("string"), width, "0")
    whole = lambda c: F.floor(c).cast("string")
    two = lambda c: F.lpad(whole(c), 2, "0")
    forms = [
        F.concat(whole(zone), F.lit("Q "), square, F.lit(" "), digits(e, 10, 4), F.lit(" "), digits(n, 10, 4)),
        F.concat(F.lower(square), digits(e, 100, 3), digits(n, 100, 3)),
        F.concat(whole(zone), F.lit("P "), whole(e), F.lit("E "), whole(n), F.lit("N")),
        F.concat(whole(8 + a / 100_000), F.lit("."), F.lpad(whole(a % 100_000), 5, "0"), F.lit(", "), whole(101 + b / 100_000), F.lit("."), F.lpad(whole(b % 100_000), 5, "0")),
        F.concat(whole(102 + b / 100_000), F.lit("°"), two(b % 60), F.lit("'"), two(b % 59), F.lit('"E '), whole(8 + a / 100_000), F.lit("°"), two(a % 60), F.lit("'"), two(a % 59), F.lit('"N')),
        F.col("c_name"),
    ]
    return t.customer.select("c_custkey", F.get(F.array(*forms), (k % 6).cast("int")).alias("typed"))


@query("""
WITH k AS (SELECT c_custkey, c_custkey % 6 AS form, 48 + c_custkey // 6 % 2 AS zone, 200000 + c_custkey * 7919 % 600000 AS e, 950000 + c_custkey * 104729 % 1600000 AS n, c_custkey * 7919 % 1500000 AS p, c_custkey * 104729 % 1200000 AS q FROM customer),
datum(datum, a, b, dx, dy, dz) AS (VALUES ('indian1960', 6377304.063::DOUBLE, 6356103.038993155::DOUBLE, 198, 881, 317), ('wgs84', 6378137.0::DOUBLE, 6356752.31424518::DOUBLE, 0, 0, 0)),
unit(form, u) AS (VALUES (0, 10), (1, 100), (2, 0)),
g AS (SELECT c_custkey, form, zone, datum, a, b, dx, dy, dz, (a - b) / (a + b) AS f, CASE WHEN u = 0 THEN CAST(e AS DOUBLE) ELSE (e // u) * u + u / 2 END AS e, CASE WHEN u = 0 THEN CAST(n AS DOUBLE) ELSE (n // u) * u + u / 2 END AS n, CASE WHEN u = 0 THEN 30 ELSE u / 2 END AS precision_m FROM k JOIN unit USING (form), datum),
s AS (SELECT *, 0.9996::DOUBLE * a / (1 + f) * (1 + f ** 2 / 4 + f ** 4 / 64) AS size FROM g),
x AS (SELECT *, (e - 500000) / size AS x, n / size AS y FROM s),
r AS (SELECT *, [f / 2 - 2 * f ** 2 / 3 + 37 * f ** 3 / 96 - f ** 4 / 360, f ** 2 / 48 + f ** 3 / 15 - 437 * f ** 4 / 1440, 17 * f ** 3 / 480 - 37 * f ** 4 / 840, 4397 * f ** 4 / 161280] AS c,
  [2 * f - 2 * f ** 2 / 3 - 2 * f ** 3 + 116 * f ** 4 / 45, 7 * f ** 2 / 3 - 8 * f ** 3 / 5 - 227 * f ** 4 / 45, 56 * f ** 3 / 15 - 136 * f ** 4 / 35, 4279 * f ** 4 / 630] AS d FROM x),
w AS (SELECT *, x - list_sum(list_transform([1, 2, 3, 4], lambda i: c[i] * cos(2 * i * y) * sinh(2 * i * x))) AS xx, y - list_sum(list_transform([1, 2, 3, 4], lambda i: c[i] * sin(2 * i * y) * cosh(2 * i * x))) AS yy FROM r),
h AS (SELECT *, asin(sin(yy) / cosh(xx)) AS chi, atan2(sinh(xx), cos(yy)) AS off FROM w),
own AS (SELECT c_custkey, form, CASE form WHEN 2 THEN 'utm' ELSE 'mgrs' END AS system, datum, a, b, dx, dy, dz, zone * 6 - 183 + degrees(off) AS lng, degrees(chi + list_sum(list_transform([1, 2, 3, 4], lambda i: d[i] * sin(2 * i * chi)))) AS lat, precision_m, CASE datum WHEN 'wgs84' THEN 2 ELSE 1 END AS place FROM h WHERE abs(degrees(off)) <= 3.5),
typed AS (SELECT c_custkey, form, CASE form WHEN 3 THEN 101 + q // 100000 + q % 100000 / 100000 ELSE 102 + q // 100000 + q % 60 / 60 + q % 59 / 3600 END AS lng, CASE form WHEN 3 THEN 8 + p // 100000 + p % 100000 / 100000 ELSE 8 + p // 100000 + p % 60 / 60 + p % 59 / 3600 END AS lat FROM k WHERE form IN (3, 4)),
al AS (SELECT * FROM own UNION ALL SELECT c_custkey, form, 'latlon', datum, a, b, dx, dy, dz, lng, lat, 0, CASE datum WHEN 'wgs84' THEN 1 ELSE 2 END FROM typed, datum WHERE datum = 'wgs84' OR form = 4 AND lng BETWEEN 101.5 AND 114 AND lat BETWEEN 7 AND 24),
v AS (SELECT *, a / sqrt(1 - (1 - (b / a) ** 2) * sin(radians(lat)) ** 2) AS r FROM al),
m AS (SELECT *, r * cos(radians(lat)) * cos(radians(lng)) + dx AS cx, r * cos(radians(lat)) * sin(radians(lng)) + dy AS cy, r * (b / a) ** 2 * sin(radians(lat)) + dz AS cz, 6378137.0::DOUBLE AS wa, 6356752.31424518::DOUBLE AS wb FROM v),
o AS (SELECT *, sqrt(cx ** 2 + cy ** 2) AS o, atan2(cz * wa, sqrt(cx ** 2 + cy ** 2) * wb) AS t FROM m),
z AS (SELECT *, degrees(atan2(cy, cx)) AS wlng, degrees(atan2(cz + (wa ** 2 - wb ** 2) / wb * sin(t) ** 3, o - (wa ** 2 - wb ** 2) / wa * cos(t) ** 3)) AS wlat FROM o),
ok AS (SELECT * FROM z WHERE form IN (3, 4) OR wlng BETWEEN 101.5 AND 114 AND wlat BETWEEN 7 AND 24)
SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY place) AS INTEGER) AS reading, system, datum, round(CASE datum WHEN 'wgs84' THEN wlat ELSE round(wlat, 8) END, 5) AS lat, round(CASE datum WHEN 'wgs84' THEN wlng ELSE round(wlng, 8) END, 5) AS lng, CAST(precision_m AS DOUBLE) AS precision_m FROM ok
""")
def q124_typed_positions(t: Tables) -> DataFrame:
    """Every reading of what was typed, on WGS 84; the twin has them from the numbers, not from the text."""
    read = _typed(t).select("c_custkey", F.posexplode(coordinates.positions(F.col("typed"))).alias("at", "p"))
    return read.select("c_custkey", (F.col("at") + 1).alias("reading"), "p.system", "p.datum", F.round("p.lat", 5).alias("lat"), F.round("p.lng", 5).alias("lng"), "p.precision_m")


# Twelve directions in turn; a shape has a corner on each, at a distance of its own.
_TURN = ((2, 0), (2, 1), (1, 2), (0, 2), (-1, 2), (-2, 1), (-2, 0), (-2, -1), (-1, -2), (0, -2), (1, -2), (2, -1))
_REACH = (7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47)


@query(f"""
WITH v AS (SELECT c_custkey AS id, i, CAST(dx * (10 + c_custkey * m % 53) AS DOUBLE) AS x, CAST(dy * (10 + c_custkey * m % 53) AS DOUBLE) AS y FROM customer, (VALUES {", ".join(f"({i}, {d[0]}, {d[1]}, {m})" for i, (d, m) in enumerate(zip(_TURN, _REACH, strict=True)))}) t(i, dx, dy, m)),
e AS (SELECT a.id, sum(a.x * b.y - b.x * a.y) / 2 AS area, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS length FROM v a JOIN v b ON a.id = b.id AND b.i = (a.i + 1) % 12 GROUP BY 1),
s AS (SELECT a.id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, (max((b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y)) - min((b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y))) AS along,
  min((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS low, max((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x)) AS high, max(CASE WHEN (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) THEN (c.x - a.x) ** 2 + (c.y - a.y) ** 2 END) AS far, min(CASE WHEN (b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) THEN (b.x - a.x) * (c.x - a.x) + (b.y - a.y) * (c.y - a.y) END) AS back
  FROM v a JOIN v b ON a.id = b.id AND a.i <> b.i JOIN v c ON c.id = a.id GROUP BY ALL),
h AS (SELECT id, sum(ax * by_ - bx * ay) / 2 AS hull, min(along * high / ((bx - ax) ** 2 + (by_ - ay) ** 2)) AS box, count(*) AS corners FROM s WHERE low >= 0 AND back >= 0 AND far <= (bx - ax) ** 2 + (by_ - ay) ** 2 GROUP BY 1)
SELECT id AS c_custkey, corners AS hull_corners, round(4 * pi() * area / length ** 2, 6) AS compactness, round(area / hull, 6) AS convexity, round(area / box, 6) AS rectangularity FROM e JOIN h USING (id)
""")
def q125_shape_quality(t: Tables) -> DataFrame:
    """How round, how convex and how rectangular each shape is."""
    k = F.col("c_custkey")
    reach = [10 + k * m % 53 for m in _REACH]
    ring = F.array(*(F.struct((x * r).cast("double").alias("x"), (y * r).cast("double").alias("y")) for (x, y), r in zip(_TURN, reach, strict=True)))
    measures = [F.round(f(F.col("ring")), 6).alias(f.__name__) for f in (geo.compactness, geo.convexity, geo.rectangularity)]
    return t.customer.select("c_custkey", ring.alias("ring")).select("c_custkey", F.size(geo.hull(F.col("ring"))).cast("long").alias("hull_corners"), *measures)


#: What people typed who did not know the spelling.
ASKED = ("Smal wigdet", "rédd rinng", "steal bolt", "gren geer", "larg anvill", "x", "bolt")


@query(f"""
WITH q AS (SELECT DISTINCT {text.fold_sql("trim(a)")} AS asked FROM (VALUES {", ".join(f"('{a}')" for a in ASKED)}) v(a)),
r AS (SELECT *, nullif(trim(regexp_replace({text.fold_sql("p_name")}, '[^a-z0-9]+', ' ', 'g')), '') AS key FROM part),
best AS (SELECT * FROM r WHERE key IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand, key ORDER BY p_retailprice DESC, p_partkey) = 1),
grams AS (SELECT s, i, w, p, substr('  ' || w || ' ', p, 3) AS gram FROM (SELECT s, i, w, unnest(range(1, length(w) + 2)) AS p FROM (SELECT s, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) AS i FROM (SELECT asked AS s FROM q UNION SELECT key FROM best)) WHERE w <> '')),
l AS (SELECT s, list(gram ORDER BY i, p) AS g FROM grams GROUP BY 1),
pairs AS (SELECT q.asked, k.key, list_distinct(a.g) AS own, b.g AS g FROM q JOIN l a ON a.s = q.asked, (SELECT DISTINCT key FROM best) k JOIN l b ON b.s = k.key WHERE length(q.asked) >= 2),
spans AS (SELECT asked, key, own, list_distinct(g[i:j]) AS part FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM pairs), LATERAL (SELECT unnest(range(i, len(g) + 1)) AS j)),
sim AS (SELECT asked, key, max(len(list_intersect(own, part)) / (len(own) + len(part) - len(list_intersect(own, part)))) AS similarity FROM spans GROUP BY 1, 2)
SELECT asked, p_brand, p_partkey, p_name, round(similarity, 6) AS similarity FROM sim JOIN best USING (key) WHERE similarity >= 0.5
""")
def q126_word_similarity(t: Tables) -> DataFrame:
    """The dearest part of each brand and name that resembles one of the misspelt queries."""
    asked = t.spark.createDataFrame([(a,) for a in ASKED], "a string")
    rows = t.part.select("p_partkey", "p_name", "p_brand", "p_retailprice")
    found = similar.best_per_key(asked, rows, "a", "p_name", "p_brand", [-F.col("p_retailprice"), F.col("p_partkey")])
    return found.select("asked", "p_brand", "p_partkey", "p_name", F.round("similarity", 6).alias("similarity"))
