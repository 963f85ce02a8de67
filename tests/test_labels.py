"""Label functions, clipping and matching against published cases and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import clip, fuzzy, geo, labels, text
from tessera.plans import records


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("a", "b", "kind"), [
    ("Rue X", "Rue X", "same"), ("", "Rue X", "typed"), ("rue x", "RUE X", "case"), ("Hue", "Huế", "accent"), ("Khanh-Hoi", "Khanh Hoi", "spacing"), ("N° 12", "No. 12", "numeral"),
    ("Bd Charner", "Boulevard Charner", "abbreviation"), ("Rue Catinat", "Quai Catinat", "generic"), ("Marché", "Marché Central", "extended"), ("Pont de fer", "Pont fer", "truncated"), ("Catinat", "Catimat", "wrong word"), ("Abattoir", "Hôpital", "rewrite"),
])
def test_diff_class(spark, a, b, kind):
    assert one(spark, labels.diff_class(F.col("a"), F.col("b")), a=a, b=b) == kind


@pytest.mark.parametrize(("name", "core", "key"), [("Đại Lộ Lê Lợi", "lê lợi", "le loi"), ("Rue Catinat", "catinat", "catinat"), ("Rạch Bến Nghé", "bến nghé", "ben nghe"), ("Đường", "", ""), ("Lê  Lợi", "lê lợi", "le loi")])
def test_label_core_and_name_key(spark, name, core, key):
    assert one(spark, text.label_core(F.col("t")), t=name) == core
    assert one(spark, labels.name_key(F.col("t")), t=name) == key


def test_small_label_rules(spark):
    assert [one(spark, labels.roman(F.col("t")), t=t) for t in ("XIV", "mcmix", "IV", "x1", "")] == [14, 1909, 4, None, None]
    assert one(spark, labels.cell_order(F.col("t")), t="12 bis") == 12.5 and one(spark, labels.cell_order(F.col("t")), t="no") is None
    assert one(spark, labels.expanded_references(F.col("t")), t="J5,6") == ["J5", "J6"]
    assert str(one(spark, labels.packed_date(F.col("t")), t="paper19240131")) == "1924-01-31" and one(spark, labels.packed_date(F.col("t")), t="paper") is None
    assert tuple(one(spark, labels.legend_entry(F.col("t")), t="3. Bệnh viện (Grall)")) == (3, "Bệnh viện", "Grall")
    assert tuple(one(spark, labels.legend_entry(F.col("t")), t="Marché")) == (None, "Marché", None)
    assert one(spark, labels.generic_only(F.col("t")), t="Rue de la") and not one(spark, labels.generic_only(F.col("t")), t="Rue Catinat")
    assert one(spark, labels.non_ascii(F.col("t")), t="Huế là") == 2


def test_blanks_come_last_and_numbers_count(spark):
    rows = spark.createDataFrame([(1, "Rue 10"), (2, None), (3, ""), (4, "Rue 2"), (5, "Rue 100"), (6, "Alpha"), (7, "Rue 11")], "id long, t string")
    assert [r["id"] for r in rows.orderBy(*labels.natural_order(F.col("t")), "id").collect()] == [6, 4, 1, 7, 5, 2, 3]


@pytest.mark.parametrize(("a", "b", "low", "high"), [("MARCHÉ", "marché", 1, 1), ("Marché", "Marche", 0.8, 0.99), (None, "", 1, 1), (" x ", "x", 1, 1), ("abc", None, 0, 0)])
def test_char_similarity(spark, a, b, low, high):
    got = spark.createDataFrame([(a, b)], "a string, b string").select(fuzzy.char_similarity("a", "b")).first()[0]
    assert low <= got <= high


def test_clipped_area(spark):
    ring = lambda points: [{"x": float(x), "y": float(y)} for x, y in points]
    rows = [
        (ring([(0, 0), (10, 0), (10, 10), (0, 10)]), 2.0, 3.0, 20.0, 7.0, 32.0),
        (ring([(0, 0), (10, 0), (0, 10)]), 0.0, 0.0, 5.0, 5.0, 25.0),
        (ring([(5, 0), (10, 5), (5, 10), (0, 5)]), 0.0, 0.0, 5.0, 10.0, 25.0),
        (ring([(0, 0), (1, 0), (1, 1)]), 5.0, 5.0, 6.0, 6.0, 0.0),
        (ring([(2, 2), (3, 2), (3, 3), (2, 3)]), 0.0, 0.0, 9.0, 9.0, 1.0),
    ]
    df = spark.createDataFrame(rows, "ring array<struct<x:double,y:double>>, x0 double, y0 double, x1 double, y1 double, want double")
    for r in clip.clip_rings(df).select("want", geo.ring_area(F.col("ring")).alias("area")).collect():
        assert r["area"] == pytest.approx(r["want"])


def test_greedy_match_on_whole_tables_equals_brute_force(spark, data):
    from tessera import catalog
    from tessera.plans.registry import Tables

    big = data.replace("0.001", "0.01")
    pairs = records._boxes(Tables(spark, big)).where("iou >= 0.3").select("sheet", "a_id", "b_id", F.round("iou", 9).alias("iou")).collect()
    used, want = set(), set()
    for r in sorted(pairs, key=lambda r: (-r["iou"], r["a_id"], r["b_id"])):
        if ("a", r["sheet"], r["a_id"]) not in used and ("b", r["sheet"], r["b_id"]) not in used:
            used |= {("a", r["sheet"], r["a_id"]), ("b", r["sheet"], r["b_id"])}
            want.add((r["sheet"], r["a_id"], r["b_id"]))
    got = {(r["sheet"], r["a_id"], r["b_id"]) for r in catalog.QUERIES["q60_greedy_match"](spark, big).collect()}
    assert got == want and len(want) > 1000


def test_seeded_order_depends_on_the_seed(spark):
    rows = spark.range(50).select("id", labels.seeded("a", F.col("id")).alias("a"), labels.seeded("b", F.col("id")).alias("b")).collect()
    by = lambda k: [r["id"] for r in sorted(rows, key=lambda r: r[k])]
    assert by("a") != by("b") != sorted(by("a")) and random.Random(0)
