"""Typed positions: published pairs, round trips, and what is no position."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import coordinates as geo


@pytest.fixture(scope="module")
def read(spark):
    column = geo.positions(F.col("q"))

    def of(*texts):
        rows = spark.createDataFrame(list(enumerate(texts)), "k int, q string").select("k", column.alias("p")).orderBy("k").collect()
        return [[h.asDict() for h in r["p"]] for r in rows]

    return of


def metres(a, b):
    return math.hypot((a["lat"] - b["lat"]) * 111_320, (a["lng"] - b["lng"]) * 111_320 * math.cos(math.radians(a["lat"])))


def test_squares_of_known_places(spark):
    places = [(10.8188, 106.6519, "48P XS"), (16.6547, 106.7331, "48Q XD"), (13.5667, 107.7167, "48P YA"), (16.4698, 107.5769, "48Q YD"), (16.0544, 108.2022, "49Q BT")]
    df = spark.createDataFrame(places, "lat double, lng double, want string").withColumn("zone", geo.zone_of(F.col("lng")))
    df = df.withColumn("u", geo.to_utm(F.col("lng"), F.col("lat"), F.col("zone")))
    got = df.select("want", F.concat(F.col("zone").cast("string"), geo.band_of(F.col("lat")), F.lit(" "), geo.square_of(F.col("u.easting"), F.col("u.northing"), F.col("zone"))).alias("got"))
    assert all(r["got"] == r["want"] for r in got.collect())


@pytest.mark.parametrize("datum", [geo.WGS84, geo.INDIAN_1960])
def test_utm_round_trip(spark, datum):
    points = [(106.7009, 10.7769), (105.8542, 21.0285), (108.2022, 16.0544), (102.0, 0.0), (104.9, 83.5)]
    df = spark.createDataFrame(points, "lng double, lat double").withColumn("zone", geo.zone_of(F.col("lng")))
    df = df.withColumn("u", geo.to_utm(F.col("lng"), F.col("lat"), F.col("zone"), datum))
    for r in df.select("lng", "lat", geo.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("zone"), datum).alias("p")).collect():
        assert abs(r["p"]["lng"] - r["lng"]) < 1e-9 and abs(r["p"]["lat"] - r["lat"]) < 1e-9


def test_utm_of_the_equator_and_a_meridian(spark):
    r = spark.range(1).select(geo.to_utm(F.lit(105.0), F.lit(0.0), F.lit(48)).alias("o"), geo.to_utm(F.lit(105.0), F.lit(90.0) - 1e-9, F.lit(48)).alias("p")).first()
    assert (r["o"]["easting"], r["o"]["northing"]) == pytest.approx((500_000, 0))
    assert r["p"]["northing"] == pytest.approx(0.9996 * 10_001_965.729, abs=0.01)  # the published quarter meridian


def test_sheet_datum(spark, read):
    [hits] = read("48Q XD 850 418")
    old, new = hits
    assert (old["datum"], new["datum"]) == ("indian1960", "wgs84")
    assert metres(old, {"lat": 16.6547, "lng": 106.7331}) < 300 and 400 < metres(new, old) < 600
    p = spark.range(1).select(geo.to_wgs84(F.lit(106.7009), F.lit(10.7769), geo.INDIAN_1960).alias("p")).first()["p"]
    assert 450 < metres(p.asDict(), {"lat": 10.7769, "lng": 106.7009}) < 520
    assert (p["lng"] - 106.7009) * 111_320 * math.cos(math.radians(p["lat"])) < -400


def test_zone_and_precision(read):
    bare, full = read("XD 850 418", "48Q XD 850 418")
    assert len(bare) == 2 and bare[0]["ref"] == "48Q XD 850 418" and bare[0]["lat"] == pytest.approx(full[0]["lat"], abs=1e-9)
    sides = {"48P XS 81 97": 1000, "48P XS 815 975": 100, "48P XS 8150 9750": 10, "48pxs8150097500": 1}
    hits = read(*sides)
    assert [h[0]["precision_m"] * 2 for h in hits] == list(sides.values())
    assert metres(hits[0][0], hits[3][0]) < 750


def test_lat_lng_forms(read):
    saigon = {"lat": 10.7769, "lng": 106.7009}
    forms = ["10.7769, 106.7009", " 10.7769 106.7009", "106.7009, 10.7769", "106.7009E 10.7769N", "N10.7769 E106.7009"]
    assert all(len(h) == 1 and metres(h[0], saigon) < 1 for h in read(*forms))
    dms, spaced = read("10°46'36\"N 106°42'03\"E", "10 46 36 N, 106 42 3 E")
    assert [h["datum"] for h in dms] == ["wgs84", "indian1960"]
    assert dms[0]["lat"] == pytest.approx(10 + 46 / 60 + 36 / 3600) and spaced[0]["lat"] == pytest.approx(dms[0]["lat"])
    assert dms[0]["ref"] == "10°46'36.0\"N 106°42'03.0\"E" and read(forms[0])[0][0]["ref"] == "10.77690°N 106.70090°E"
    assert [round(h[0]["lat"], 4) for h in read("33.5S 70.25W", "-33.5, -70.25")] == [-33.5, -33.5]


def test_utm_text(read):
    [hits] = read("48P 683000 1192000")
    assert [h["datum"] for h in hits] == ["indian1960", "wgs84"] and metres(hits[0], {"lat": 10.78, "lng": 106.67}) < 1000
    assert hits[0]["ref"] == "48P 683000E 1192000N" and hits[0]["west"] < hits[0]["lng"] < hits[0]["east"]


def test_no_position(read):
    texts = ["Ben Thanh market", "District 1", "Saigon 1968", "map 1968", "1968 1972", "2 5", "Highway 1", "", None, "Chợ Lớn", "7" * 4000]
    wrong = ["48P AA 123 456", "48P XS 999999 999999", "10°76'00\"N 106°42'00\"E", "10N 20N", "95.5N 10.5E", "48P XS 123 45"]
    assert read(*texts, *wrong) == [[]] * (len(texts) + len(wrong))
