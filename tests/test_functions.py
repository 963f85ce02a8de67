"""Values taken over from the surveyed system's published cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions import geo, stats, text


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return row.select(column).first()[0]


@pytest.mark.parametrize(("word", "folded"), [("ĐƯỜNG", "duong"), ("Đông", "dong"), ("Ðông", "dong"), ("Hue\u0302\u0301", "hue"), ("Huế", "hue"), ("Cœur", "coeur"), ("Straße", "strasse"), ("MARCHÉ", "marche"), (None, None), ("", "")])
def test_fold(spark, word, folded):
    assert one(spark, text.fold(F.col("t")), t=word) == folded


@pytest.mark.parametrize(("name", "core"), [("Đại Lộ Lê Lợi", "dai lo le loi"), ("Rue Catinat", "catinat"), ("Chợ Lớn", "cho lon"), ("Rue de la Paix", "paix"), ("Vge de Khánh Hội", "khanh hoi"), ("R. Catinat", "catinat"), ("Pont Tournant de", "tournant"), ("Quai des Belges", "belges"), ("  ", None)])
def test_core_key(spark, name, core):
    got = one(spark, text.core_key(F.col("t")), t=name)
    assert got == core


def test_slug(spark):
    assert one(spark, text.slug(F.col("t")), t="  Plan de Huế -- 1923! ") == "plan-de-hue-1923"
    assert one(spark, F.length(text.slug(F.col("t"))), t="a" * 200) == 80


def test_query_tokens():
    assert text.query_tokens("Plan d’Hanoï 1920s") == ["plan", "d", "hanoi", "192"]


def test_subsequence_and_digits(spark):
    assert one(spark, text.is_subsequence(F.split("a", " "), F.split("b", " ")), a="rue paix", b="rue de la paix")
    assert not one(spark, text.is_subsequence(F.split("a", " "), F.split("b", " ")), a="paix rue", b="rue de la paix")
    assert one(spark, text.digit_signature(F.col("a")), a="N°29 bis 3") == "29,3"
    assert one(spark, text.year_in(F.col("a")), a="levé en 1882, tiré 1901") == 1882
    assert one(spark, text.year_in(F.col("a")), a="feuille 12345") is None


def test_html_text(spark):
    assert one(spark, text.html_text(F.col("h")), h="<p>Tom &amp;\n <b>J</b></p><script>x='<p>'</script>") == "Tom & J"


@pytest.mark.parametrize(("a", "b", "d"), [(0, 180, 0), (-90, 90, 0), (0, 90, 90), (-45, 0, 45), (170, 5, 15)])
def test_axial_difference(spark, a, b, d):
    assert one(spark, geo.axial_difference(F.col("a"), F.col("b")), a=float(a), b=float(b)) == d


@pytest.mark.parametrize(("other", "iou"), [((0.0, 0.0, 10.0, 10.0), 1.0), ((5.0, 0.0, 10.0, 10.0), 50 / 150), ((20.0, 0.0, 1.0, 1.0), 0.0)])
def test_box_iou(spark, other, iou):
    values = dict(zip("pqrs", other, strict=True)) | {"a": 0.0, "b": 10.0}
    c = F.col
    assert one(spark, geo.box_iou(c("a"), c("a"), c("b"), c("b"), c("p"), c("q"), c("r"), c("s")), **values) == pytest.approx(iou)


def test_ring(spark):
    square = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0))))
    row = spark.range(1).select(geo.ring_area(square), geo.in_ring(square, F.lit(1.0), F.lit(1.0)), geo.in_ring(square, F.lit(5.0), F.lit(1.0))).first()
    assert tuple(row) == (16.0, True, False)


def test_compass_and_distance(spark):
    c = F.col
    assert one(spark, geo.compass(geo.bearing(c("a"), c("a"), c("b"), c("a"))), a=0.0, b=1.0) == "E"
    assert one(spark, geo.haversine(c("a"), c("a"), c("b"), c("a")), a=0.0, b=1.0) == pytest.approx(111195, abs=1)


def test_closed_box_edges(spark):
    c = F.col
    inside = geo.box_contains(c("w"), c("s"), c("e"), c("n"), c("x"), c("y"))
    edges = {"w": 100.0, "s": 10.0, "e": 110.0, "n": 20.0}
    assert one(spark, inside, x=110.0, y=20.0, **edges) and one(spark, inside, x=100.0, y=10.0, **edges)
    assert not one(spark, inside, x=110.000001, y=20.0, **edges)


def test_wilson(spark):
    low, high = stats.wilson(F.col("k"), F.col("n"))
    row = spark.createDataFrame([(9, 10), (0, 0)], "k int, n int").select(low.alias("l"), high.alias("h")).collect()
    assert (round(row[0]["l"], 2), round(row[0]["h"], 2)) == (0.6, 0.98) and row[1]["l"] is None


def test_fuzzy_functions(spark):
    from tessera.functions import fuzzy

    df = spark.createDataFrame([("MARCHÉ", "marché"), ("MARCHÉ", "marche"), (None, "x")], "a string, b string").coalesce(1)
    got = [r[0] for r in df.select(fuzzy.char_similarity("a", "b")).collect()]
    assert got[0] == 1.0 and 0.8 < got[1] < 1.0 and got[2] == 0.0  # null counts as empty
    row = spark.range(1).select(
        fuzzy.closed_up(F.lit("la R I V I È R E de l a")),
        fuzzy.has_diacritic(F.lit("Rạch")),
        fuzzy.has_diacritic(F.lit("N°29")),
        fuzzy.token_cost(F.lit(1_000_000), F.lit(-5), F.lit(10), {"input": F.lit(2.0), "cached": F.lit(0.5), "output": F.lit(8.0)}),
        fuzzy.localised_number(F.lit("15.154")),
        fuzzy.spelling_variants(F.lit("Bến Nghé")),
        fuzzy.period(F.lit(1901), [("old", None, 1900), ("new", 1901, None)]),
        fuzzy.zoom_for_span(F.lit(360.0)),
    ).first()
    assert row[0] == "la RIVIÈRE de l a" and row[1] and not row[2] and row[3] == 2.00008 and row[4] == 15154
    assert row[5] == ["Bến Nghé", "Bến-Nghé", "ben nghe", "ben-nghe"] and row[6] == "new" and row[7] == 4.0
