"""The keys in SQL give what their columns give, and are inlined; nearest targets equal brute force."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tessera.functions import sql, text
from tessera.operators import spatial


def test_functions_equal_columns(spark):
    assert sql.register(spark) == list(sql.FUNCTIONS)
    names = ["Đại Lộ Lê Lợi", "Rue Catinat", "Chợ Lớn", "Đường", "rue de la  Paix", "Ðông", "Cœur & Straße", "", "--", None, "Hô", "Plan de Huế " * 12]
    df = spark.createDataFrame([(n,) for n in names], "x string").repartition(2)
    columns = {"f_unaccent": text.fold, "place_key": text.place_key, "place_core_key": text.core_key, "label_core": text.label_core, "map_slug_base": text.slug}
    for name, column in columns.items():
        both = df.select(F.expr(f"{name}(x)").alias("a"), column(F.col("x")).alias("b"))
        assert both.where("NOT (a <=> b)").count() == 0, name
    df.createOrReplaceTempView("named")
    plan = spark.sql("SELECT place_core_key(x) AS a, map_slug_base(x) AS b FROM named")._jdf.queryExecution().optimizedPlan().toString()
    assert "place_core_key(" not in plan and "UDF" not in plan and "translate(" in plan


def test_nearest_equals_brute_force(spark):
    rng = random.Random(4)
    points = [(k, rng.uniform(-300, 300), rng.uniform(-300, 300)) for k in range(60)] + [(60, None, 1.0)]
    targets = [(k, rng.uniform(-20, 20), rng.uniform(200, 230)) for k in range(25)] + [(100, 5.0, 5.0), (101, 5.0, 5.0)]
    p, t = spark.createDataFrame(points, "p long, px double, py double"), spark.createDataFrame(targets, "t long, tx double, ty double")
    want = {}
    for k, x, y in points[:-1]:
        best = sorted((math.hypot(x - tx, y - ty), n) for n, tx, ty in targets)[:4]
        want |= {(k, place): n for place, (_, n) in enumerate(best, 1)}
    got = {(r["p"], r["place"]): r["t"] for r in spatial.nearest(p, t, "p", "t", 4, 3.0).collect()}
    assert got == want
    few = spatial.nearest(p, t.limit(2), "p", "t", 4, 3.0)
    assert few.count() == 120 and spatial.nearest(p, t.limit(0), "p", "t", 4, 3.0).count() == 0 and spatial.nearest(p.limit(0), t, "p", "t", 4, 3.0).count() == 0
