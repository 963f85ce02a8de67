"""Word similarity and hulls against brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.operators import similar


def grams(s):
    return [w[i : i + 3] for w in (f"  {x} " for x in s.split()) for i in range(len(w) - 2)]


def brute(query, key):
    own, g = set(grams(query)), grams(key)
    spans = [set(g[i:j]) for i in range(len(g)) for j in range(i + 1, len(g) + 1)]
    return max((len(own & s) / len(own | s) for s in spans), default=0.0)


def test_published_value(spark):
    r = spark.range(1).select(similar.word_similarity(F.array_distinct(similar.trigram_list(F.lit("word"))), similar.trigram_list(F.lit("two words"))).alias("s")).first()
    assert r["s"] == pytest.approx(0.8)


@pytest.mark.parametrize("least", [0.3, 0.5, 1.0])
def test_resembling_equals_brute_force(spark, least):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 6)))
    keys = [" ".join(word() for _ in range(rng.randrange(1, 4))) for _ in range(120)] + ["", None, "abc", "abc"]
    asked = [" ".join(word() for _ in range(rng.randrange(1, 3))) for _ in range(15)] + ["", None, "zzz"]
    got = similar.resembling(spark.createDataFrame([(a,) for a in asked], "q string"), spark.createDataFrame([(k, 1) for k in keys], "k string, query int"), "q", "k", least)
    want = {(a, k): brute(a, k) for a in asked if a for k in keys if k}
    found = {(r["query"], r["key"]): r["similarity"] for r in got.collect()}
    assert found == pytest.approx({pair: s for pair, s in want.items() if s >= least - 1e-12}) and got.count() == len(found)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_best_per_key(spark):
    rows = [(1, "m", "Rue Catinat", 0.5), (2, "m", "rue catinat", 0.9), (3, "n", "RUE CATINAT", 0.1), (4, "m", "Quai", 1.0), (5, "m", None, 1.0)]
    df = spark.createDataFrame(rows, "id int, sheet string, label string, confidence double")
    got = similar.best_per_key(spark.createDataFrame([("Catinât",), ("q",)], "a string"), df, "a", "label", "sheet", [-F.col("confidence"), F.col("id")])
    assert sorted((r["asked"], r["sheet"], r["id"]) for r in got.collect()) == [("catinat", "m", 2), ("catinat", "n", 3)]


def cross(o, a, b):
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def test_hull_equals_brute_force(spark):
    rng = random.Random(6)
    sets = [[(rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(0, 14))] for _ in range(60)] + [[(0, 0)] * 3, [(0, 0), (2, 2), (1, 1)]]
    df = spark.createDataFrame([(k, [(float(x), float(y)) for x, y in s]) for k, s in enumerate(sets)], "k int, p array<struct<x:double,y:double>>")
    for r in df.select("k", geo.hull(F.col("p")).alias("h")).collect():
        points, got = set(sets[r["k"]]), [(p["x"], p["y"]) for p in r["h"]]
        # A corner is a point that lies in no segment and no triangle of others: an edge has all others on its left.
        edges = [(a, b) for a in points for b in points if a != b and all(cross(a, b, c) > 0 or cross(a, b, c) == 0 and min(a, b) <= c <= max(a, b) for c in points)]
        assert set(got) == ({a for a, _ in edges} if edges else points) and len(got) == len(set(got))
        turns = [cross(got[i - 2], got[i - 1], got[i]) for i in range(len(got))] if len(got) > 2 else []
        assert all(t > 0 for t in turns)


def test_shares_of_known_shapes(spark):
    square = [(0.0, 0.0), (2.0, 2.0), (0.0, 4.0), (-2.0, 2.0)]
    ell = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (1.0, 1.0), (1.0, 2.0), (0.0, 2.0)]
    df = spark.createDataFrame([(0, square), (1, ell), (2, [(0.0, 0.0)]), (3, None)], "k int, p array<struct<x:double,y:double>>")
    got = [(r["c"], r["b"]) for r in df.select("k", geo.convexity(F.col("p")).alias("c"), geo.rectangularity(F.col("p")).alias("b")).orderBy("k").collect()]
    assert got[0] == pytest.approx((1, 1)) and got[1] == pytest.approx((3 / 3.5, 3 / 4)) and got[2:] == [(None, None), (None, None)]
