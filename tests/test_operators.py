"""Operators on the surveyed system's published cases, and audits that must refuse bad input."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import audit, facets, rank, resolve, rollup, spatial, state
from tessera.sources import readers, writers
from tessera.streaming import windows

ROWS = [("a", "pending", "street", 0.9, "Rue Catinat"), ("b", "validated", "street", 0.5, "Rue Pasteur"), ("c", "validated", "place", 0.95, "Cho Ben Thanh"), ("d", "rejected", "place", 0.2, "noise")]
SCHEMA = "id string, status string, cat string, conf double, text string"


def ids(df):
    return "".join(sorted(r["id"] for r in df.collect()))


def test_facet_selection_and_counts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)

    def tests(status=(), cat=(), conf=None):
        return facets.tested(df, {"status": facets.any_of(F.col("status"), list(status)), "cat": facets.any_of(F.col("cat"), list(cat)), "conf": facets.in_range(F.col("conf"), conf)})

    assert ids(facets.matched(tests())) == "abcd"
    assert ids(facets.matched(tests(["pending", "validated"]))) == "abc"
    assert ids(facets.matched(tests(["pending", "validated"], ["place"]))) == "c"
    assert ids(facets.matched(tests(conf=0.9))) == "ac"
    counts = facets.facet_counts(tests(["pending"], ["street"]), {"status": F.col("status"), "cat": F.col("cat")})
    assert {(r["dim"], r["value"]): r["n"] for r in counts.collect()} == {("status", "pending"): 1, ("status", "validated"): 1, ("cat", "street"): 1}


def test_year_range_and_dense_bins(spark):
    df = spark.createDataFrame([(1791,), (1882,), (1965,), (1969,), (None,)], "year int")
    assert [r[0] for r in df.where(facets.in_range(F.col("year"), 1880, 1969)).collect()] == [1882, 1965, 1969]
    assert df.where(facets.in_range(F.col("year"))).count() == 5
    bins = {r["bin"]: r["n"] for r in facets.dense_bins(df, F.col("year")).collect()}
    assert len(bins) == 18 and bins[1790] == 1 and bins[1960] == 2 and bins[1800] == 0


def test_keyset_walk_returns_each_row_once(spark):
    df = spark.range(0, 1202).select(F.col("id"), F.lit("same").alias("name"), F.when(F.col("id") < 1200, 1900).cast("long").alias("year"))
    keys = [F.coalesce("year", F.lit(facets.NO_YEAR)), F.col("name"), F.col("id")]
    cursor, seen = None, []
    while True:
        page = facets.keyset_page(df, keys, 100, cursor).orderBy("place").collect()
        seen += [r["id"] for r in page]
        if not page or not page[-1]["more"]:
            break
        cursor = [page[-1]["year"] if page[-1]["year"] is not None else facets.NO_YEAR, "same", page[-1]["id"]]
    assert len(seen) == 1202 and len(set(seen)) == 1202 and set(seen[-2:]) == {1200, 1201}


def test_visibility_null_is_not_staff(spark):
    df = spark.createDataFrame([("public",), ("featured",), ("draft",), ("archived",)], "status string")
    assert [facets.visible(df, "status", staff).count() for staff in (False, None, True)] == [2, 2, 3]


def test_supersession_needs_both_halves(spark):
    originals = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id int")
    parts = spark.createDataFrame([(1, "W"), (2, "W"), (2, "E"), (3, None)], "id int, half string")
    half = F.col("half")
    left = state.superseded(originals, parts, "id", half.isNull(), (half == "W", half == "E"))
    assert sorted(r[0] for r in left.collect()) == [1, 4]


def test_most_frequent_ties(spark):
    df = spark.createDataFrame([("k", "aa"), ("k", "bbb"), ("k", None), ("l", "z"), ("l", "z"), ("l", "y")], "key string, name string")
    assert {r["key"]: r["name"] for r in rollup.most_frequent(df, ["key"], "name").collect()} == {"k": "aa", "l": "z"}
    assert {r["key"]: r["name"] for r in rollup.most_frequent(df, ["key"], "name", longest=True).collect()} == {"k": "bbb", "l": "z"}


def test_thin_keeps_ends(spark):
    df = spark.range(0, 23).withColumn("g", F.lit(1))
    kept = sorted(r["id"] for r in rank.thin(df, ["g"], ["id"], 5).collect())
    assert len(kept) == 5 and kept[0] == 0 and kept[-1] == 22
    assert rank.thin(df.where("id < 4"), ["g"], ["id"], 5).count() == 4


def test_audits_can_refuse(spark):
    rows = spark.createDataFrame([(1, 5), (2, -1), (3, None)], "id int, v int")
    assert audit.rule(rows, "FAIL", "negative", F.col("v") < 0, F.col("id"), F.col("v")).collect()[0]["subject"] == "2"
    assert audit.dangling(rows, "id", rows.where("id < 3"), "id", "FAIL", "x").collect()[0]["detail"] == "1 rows"
    assert audit.duplicated(rows.union(rows.where("id = 1")), ["id", "v"], "WARN", "twice").count() == 1
    assert audit.duplicated(rows, ["id"], "WARN", "twice").count() == 0


def test_multiset_diff(spark):
    old, new = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "k string"), spark.createDataFrame([("a",), ("b",), ("d",)], "k string")
    assert {r["k"]: r["change"] for r in audit.multiset_diff(old, new, ["k"]).collect()} == {"a": "drifted", "b": "in sync", "c": "missing", "d": "new"}


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 30)]
    labels = {r["node"]: r["label"] for r in resolve.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert all(labels[k] == 0 for k in range(41)) and all(labels[100 + k] == 100 for k in range(30))


def test_components_take_few_rounds(spark, monkeypatch):
    """A chain of 10,000 shuffled nodes, whose diameter a round for each step would follow."""
    import random

    nodes = random.Random(4).sample(range(1, 10**6), 10_000)
    rounds, pick = [], resolve._smallest_neighbours
    monkeypatch.setattr(resolve, "_smallest_neighbours", lambda edges: rounds.append(1) or pick(edges))
    labels = resolve.components(spark.createDataFrame(list(zip(nodes, nodes[1:], strict=False)), "a long, b long"))
    assert labels.count() == 10_000 and {r["label"] for r in labels.select("label").distinct().collect()} == {min(nodes)}
    assert len(rounds) <= 20


def test_radius_join_equals_brute_force(spark):
    points = spark.range(0, 300).select("id", (F.rand(3) * 0.2 + 105).alias("lng"), (F.rand(4) * 0.2 + 10).alias("lat")).cache()
    centres = points.where("id % 10 = 0").select(F.col("id").alias("c"), F.col("lng").alias("c_lng"), F.col("lat").alias("c_lat"))
    from tessera.functions.geo import haversine

    want = points.crossJoin(centres).where(haversine(*map(F.col, ("lng", "lat", "c_lng", "c_lat"))) <= 3000)
    got = spatial.radius_join(points, centres, 3000.0)
    assert sorted((r["id"], r["c"]) for r in got.collect()) == sorted((r["id"], r["c"]) for r in want.collect())


def test_grid_reference(spark):
    ref = spatial.grid_reference(F.lit(850), F.lit(550), 1000, 1000, list("ABCDEFGHJK"), [str(k) for k in range(1, 11)])
    assert spark.range(1).select(ref).first()[0] == "J 6"


def test_claim_order(spark):
    at = lambda h: datetime(2024, 1, 1, h)
    jobs = spark.createDataFrame([(1, "queued", 0, at(2), None, 0), (2, "queued", 5, at(3), None, 0), (3, "running", 9, at(0), at(1), 1), (4, "running", 9, at(0), at(9), 1), (5, "queued", 9, at(0), None, 3)], "id int, status string, priority int, created_at timestamp_ntz, started_at timestamp_ntz, attempts int")
    assert [r["id"] for r in state.claim_order(jobs, "2024-01-01 10:00:00").collect()] == [2, 1, 3]


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([(1, "a", None), (2, "b", 3)], "k int, t string, x int")
    first.write.parquet(path)
    more = spark.createDataFrame([(1, "a", None), (3, "c", 1), (3, "c", 1)], "k int, t string, x int")
    assert writers.append_new(more, path, ["k", "t", "x"]) == (3, 1)
    assert writers.append_new(more, path, ["k", "t", "x"]) == (3, 0)


def test_json_lines_with_half_a_line(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n{"a": 3, "b')
    good, bad = readers.json_lines(spark, str(tmp_path / "log.jsonl"), "a int, b string")
    assert sorted(r["a"] for r in good.collect()) == [1, 2] and bad.count() == 1


def test_csv_round_trip_with_quotes(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("line\nbreak", "plain")], "p string, q string")
    writers.write_csv(df, str(tmp_path / "c"))
    assert sorted(readers.csv(spark, str(tmp_path / "c"), "p string, q string").collect()) == sorted(df.collect())


def test_geojson_ring_is_closed(spark, tmp_path):
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0))))
    feature = writers.geojson_features(spark.range(1).withColumn("ring", ring), "id", "ring", ["id"]).first()[0]
    (tmp_path / "f.json").write_text('{"type": "FeatureCollection", "features": [' + feature.replace('"id":0,"prop', '"id":"0","prop') + "]}")
    row = readers.geojson(spark, str(tmp_path / "f.json")).first()
    assert row["geometry"] == "Polygon" and row["coordinates"].count("[0.0,0.0]") == 2


def test_job_stream(spark, tmp_path):
    folder = tmp_path / "in"
    rows = [(1, "running", datetime(2024, 1, 1, 0)), (1, "done", datetime(2024, 1, 1, 1)), (2, "done", datetime(2024, 1, 1, 0)), (3, "running", datetime(2024, 1, 1, 2))]
    spark.createDataFrame(rows, "job long, status string, ts timestamp").coalesce(1).write.parquet(str(folder))
    stream = spark.readStream.schema("job long, status string, ts timestamp").parquet(str(folder))
    found = windows.run_once(windows.job_states(stream), "job_states", str(tmp_path / "ck"), "update")
    last = {r["job"]: (r["status"], r["attempts"]) for r in found.collect()}
    assert last[1] == ("done", 1) and last[2] == ("queued", 0) and last[3][1] == 1


def test_greedy_match_equals_brute_force(spark):
    import random

    from tessera.operators.score import greedy_match

    rng = random.Random(1)
    pairs = [(g, a, b, rng.choice([0.3, 0.5, 0.5, 0.9])) for g in range(4) for a in range(8) for b in range(8) if rng.random() < 0.5]
    want = set()
    for g in range(4):
        seen_a, seen_b = set(), set()
        for _, a, b, s in sorted((p for p in pairs if p[0] == g), key=lambda p: (-p[3], p[1], p[2])):
            if a not in seen_a and b not in seen_b:
                seen_a.add(a)
                seen_b.add(b)
                want.add((g, a, b, s))
    df = spark.createDataFrame(pairs, "g int, a int, b int, s double").repartition(3)
    assert {tuple(r) for r in greedy_match(df, "g", "a", "b", "s").collect()} == want


def test_greedy_match_in_rounds_equals_brute_force(spark):
    """One hot group with ties, a repeated pair, and scores and members that are null."""
    import random

    from tessera.operators.score import greedy_match

    rng = random.Random(2)
    pairs = [(1, a, b, rng.choice([None, 0.3, 0.5, 0.9])) for a in [None, *range(25)] for b in range(25) if rng.random() < 0.3]
    pairs += [(1, 100, 100, 0.7), (1, 100, 100, 0.7), (1, 100, 100, 0.2), (None, 1, 1, 0.4), (None, 1, 2, 0.6)]
    want, seen_a, seen_b = set(), set(), set()
    first = lambda p: (p[3] is None, -(p[3] or 0), p[1] is not None, p[1] or 0, p[2])
    for g, a, b, s in sorted(pairs, key=first):
        if (g, a) not in seen_a and (g, b) not in seen_b:
            seen_a.add((g, a))
            seen_b.add((g, b))
            want.add((g, a, b, s))
    df = spark.createDataFrame(pairs, "g int, a int, b int, s double").repartition(3)
    found = greedy_match(df, "g", "a", "b", "s", few=0)
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_greedy_match_puts_few_pairs_into_a_task(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    from tessera.operators.score import greedy_match

    held, plain = [], PandasGroupedOpsMixin.applyInPandas
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda self, *rest: held.append(self._df.count()) or plain(self, *rest))
    df = spark.range(300).selectExpr("1 AS g", "id AS a", "explode(array(id, id + 1)) AS b", "rand(3) AS s")
    found = greedy_match(df, "g", "a", "b", "s", few=40)
    assert held[0] <= 40 and found.count() == found.select("a").distinct().count() == found.select("b").distinct().count() > 150


def test_change_classes(spark):
    from tessera.operators.score import change_classes

    overlaps = spark.createDataFrame([(1, 1, 0.9), (2, 2, 0.5), (3, 3, 0.4), (3, 4, 0.4), (4, 5, 0.4), (5, 5, 0.4)], "o int, n int, iou double")
    old, new = spark.createDataFrame([(k,) for k in range(1, 7)], "o int"), spark.createDataFrame([(k,) for k in range(1, 7)], "n int")
    got = {(r["side"], r["id"]): r["class"] for r in change_classes(overlaps, old, new, "o", "n").collect()}
    assert [got["old", k] for k in range(1, 7)] == ["unchanged", "reshaped", "split", "merged", "merged", "gone"]
    assert [got["new", k] for k in range(1, 7)] == ["unchanged", "reshaped", "split", "split", "merged", "new"]
