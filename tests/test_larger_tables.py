"""What larger tables showed: work follows different rows and not their copies, and no table is sent whole to every task."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera import catalog
from tessera.operators import order, overlay, resolve, score, spatial
from tests.test_overlay import frame, make_shapes


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def wide(spark):
    """The default limit of broadcasts, far above the tests' tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_overlaps_send_no_edges_to_every_task(wide, monkeypatch):
    """shapes of a small file are large once their edges are listed."""
    monkeypatch.setattr(overlay, "COPIES", 3)
    monkeypatch.setattr(overlay, "BLOCK", 4)
    shapes = make_shapes(5, 10, 12)
    a = frame(wide, shapes * 5).withColumnRenamed("id", "a")
    b = frame(wide, shapes).withColumnRenamed("id", "b")
    found = overlay.overlaps(a, b, "a", "b", 7.0)
    assert "Broadcast" not in plan_of(found)
    got = {(r["a"], r["b"]): r["shared"] for r in found.collect()}
    assert found.count() == len(got) == 5 * len({k for k in got if k[0] < 10})
    assert all(got[i, j] == pytest.approx(got[i % 10, j]) for i, j in got)
    own = {r["a"]: r["a_area"] for r in found.collect()}
    assert all(got[k, k] == pytest.approx(own[k]) for k in range(10))


def test_smallest_ring_looks_once_for_equal_points(spark):
    """3,000 points on 10 places in 400 copies of 4 rings meet as 10 and 4."""
    points = spark.range(3000).select(F.col("id").alias("point_id"), (F.col("id") % 10 + 0.5).alias("x"), F.lit(1.5).alias("y"))
    vertex = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    w = F.col("id") % 4 * 2 + 4
    rings = spark.range(400).select(F.col("id").alias("k"), F.array(vertex(0, 0), vertex(w, 0), vertex(w, w), vertex(0, w)).alias("ring"))
    found = spatial.smallest_ring(points, rings, ["k"], 2.0)
    got = {r["point_id"]: (r["k"], r["area"]) for r in found.collect()}
    want = {p: next((k, (2.0 * k + 4) ** 2) for k in range(4) if p % 10 < 2 * k + 4) for p in range(3000)}
    assert got == want
    assert most_rows(found) <= 3000


def most_rows(df) -> int:
    """Most rows that a join of the executed plan gives."""
    df.collect()
    rows, left = [0], [df._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            left.append(node.executedPlan())
        elif "QueryStage" in name:
            left.append(node.plan())
        children = node.children()
        left += [children.apply(k) for k in range(children.size())]
        if "Join" in name:
            rows.append(node.metrics().apply("numOutputRows").value())
    return max(rows)


def written(spark, folder, **tables) -> str:
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def repeated(spark, data: str, tables: dict[str, tuple[str, int]], n: int, folder) -> str:
    """n copies of tables with their keys (name, shift) shifted."""
    copies = {t: spark.read.parquet(f"{data}/{t}.parquet").crossJoin(spark.range(n).withColumnRenamed("id", "_n")) for t in tables}
    return written(spark, folder, **{t: df.withColumn(tables[t][0], F.col(tables[t][0]) + F.col("_n") * tables[t][1]).drop("_n") for t, df in copies.items()})


BOTH = {"customer": ("c_custkey", 63_000), "supplier": ("s_suppkey", 63_000)}


def test_area_selection_chooses_once_for_equal_areas(spark, data, tmp_path):
    """F8: copies on the same places don't multiply the pairs."""
    query = catalog.QUERIES["q111_area_selection"]
    once, often = query(spark, data), query(spark, repeated(spark, data, BOTH, 6, tmp_path / "t"))
    assert often.count() >= 6 * once.count() > 0
    assert most_rows(often) <= 18 * most_rows(once)


def test_radius_looks_once_from_equal_places(spark, data, tmp_path):
    """with six times the points and centres on the same places, no join gives more than their number needs."""
    folder = repeated(spark, data, {"customer": ("c_custkey", 100_000), "supplier": ("s_suppkey", 100_000)}, 6, tmp_path / "t")
    query = catalog.QUERIES["q33_radius"]
    once, often = query(spark, data), query(spark, folder)
    assert most_rows(often) <= max(most_rows(once), often.count())
    shortest = {(r["s_suppkey"], r["distance_m"]) for r in often.where("place = 1").collect()}
    assert shortest == {(r["s_suppkey"] + 100_000 * n, r["distance_m"]) for r in once.where("place = 1").collect() for n in range(6)}


def test_shrunk_boxes_lose_no_pair(spark):
    """boxes that may not reach the least IoU don't meet, all others do."""
    rng = random.Random(12)
    some = lambda: (rng.randrange(0, 400) / 4, rng.randrange(0, 400) / 4, rng.randrange(20, 60) / 4, rng.randrange(20, 60) / 4)
    a = spark.createDataFrame([(k, *some()) for k in range(300)] + [(900, 0.0, 0.0, 8.0, 8.0)], "a long, ax double, ay double, aw double, ah double")
    b = spark.createDataFrame([(k, *some()) for k in range(300)] + [(900, 0.0, 0.0, 8.0, 4.0), (901, 4.0, 4.0, 4.0, 8.0)], "b long, bx double, by double, bw double, bh double")
    every = spatial.overlapping_boxes(a, b, 7.0)
    for least in (0.25, 0.3, 0.5, 1.0):
        found = spatial.overlapping_boxes(a, b, 7.0, least=least)
        want = {(r["a"], r["b"], r["iou"]) for r in every.where(F.col("iou") >= least).collect()}
        rows = [(r["a"], r["b"], r["iou"]) for r in found.collect()]
        assert set(rows) == want and len(rows) == len(want)
    assert (900, 900) in {(r["a"], r["b"]) for r in spatial.overlapping_boxes(a, b, 7.0, least=0.5).collect()}


def test_box_match_looks_once_for_equal_boxes(spark, data, tmp_path):
    shift = 2000 * 23 * 19
    folder = repeated(spark, data, {"customer": ("c_custkey", shift), "part": ("p_partkey", 2000)}, 5, tmp_path / "t")
    query = catalog.QUERIES["q35_box_iou_match"]
    once, often = query(spark, data), query(spark, folder)
    assert {tuple(r) for r in often.collect()} == {(r[0] + 2000 * n, r[1], r[2]) for r in once.collect() for n in range(5)}
    assert most_rows(often) <= max(most_rows(once), often.count())


def test_reject_reasons_look_once_for_equal_boxes(spark, data, tmp_path):
    """F14."""
    shift = 2000 * 23 * 19
    folder = repeated(spark, data, {"customer": ("c_custkey", shift * 8), "part": ("p_partkey", 2000)}, 5, tmp_path / "t")
    query = catalog.QUERIES["q90_reject_reasons"]
    once, often = query(spark, data), query(spark, folder)
    assert {tuple(r) for r in often.collect()} == {(r[0], 5 * r[1], r[2]) for r in once.collect()}
    assert most_rows(often) <= max(most_rows(once), 1000)


def test_mutual_nearest_looks_once_from_equal_places(spark, data, tmp_path):
    """F15."""
    folder = repeated(spark, data, {"customer": ("c_custkey", 100_000), "supplier": ("s_suppkey", 1000)}, 5, tmp_path / "t")
    query = catalog.QUERIES["q86_mutual_nearest"]
    once, often = query(spark, data), query(spark, folder)
    assert {tuple(r) for r in often.collect()} == {tuple(r) for r in once.collect()}
    assert most_rows(often) <= most_rows(once)


def test_box_contains_counts_equal_points_once(spark, data, tmp_path):
    """F18."""
    folder = repeated(spark, data, {"orders": ("o_orderkey", 1_000_000), "supplier": ("s_suppkey", 6300)}, 5, tmp_path / "t")
    query = catalog.QUERIES["q34_box_contains"]
    once, often = query(spark, data), query(spark, folder)
    assert {tuple(r) for r in often.collect()} == {(r[0] + 6300 * n, 5 * r[1], r[2]) for r in once.collect() for n in range(5)}
    assert most_rows(often) <= max(most_rows(once), often.count())


def test_components_and_links_send_no_table_to_every_task(wide):
    """what is read from small files is large in memory."""
    chain = wide.range(50).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    sent = []
    kept, resolve.shared.stored = resolve.shared.stored, lambda df, *rest: sent.append("Broadcast" in plan_of(df)) or kept(df, *rest)
    try:
        labels = resolve.components(chain)
    finally:
        resolve.shared.stored = kept
    assert len(sent) > 3 and not any(sent) and {r["label"] for r in labels.collect()} == {0}
    rows = wide.range(100).selectExpr("id", "id % 7 as sheet", "id % 3 as name", "id * 13.0 % 50 as x", "id * 31.0 % 50 as y")
    assert "Broadcast" not in plan_of(resolve.nearest_links(rows, "sheet", "name", "id", 9.0))


def test_nearest_links_of_equal_distances(spark):
    """7, 4 and 8, 1 are equally far; the smaller id wins."""
    rows = spark.createDataFrame([(0, 0, "n", 0.0, 0.0), (1, 1, "n", 8.0, 1.0), (2, 1, "n", 7.0, 4.0)], "id long, sheet int, name string, x double, y double")
    assert [tuple(r)[:2] for r in resolve.nearest_links(rows, "sheet", "name", "id", 9.0).collect()] == [(0, 1)]


def test_fragments_link_by_their_first_copy(spark, data, tmp_path):
    """copies on one place add no links, and all of them join."""
    folder = repeated(spark, data, {"part": ("p_partkey", 2000)}, 5, tmp_path / "t")
    query = catalog.QUERIES["q120_joined_fragments"]
    rows = []
    kept, resolve.shared.stored = resolve.shared.stored, lambda df, *rest: rows.append((out := kept(df, *rest)).count()) or out
    try:
        once = query(spark, data).collect()
        first = max(rows)
        rows.clear()
        often = query(spark, folder).collect()
    finally:
        resolve.shared.stored = kept
    assert max(rows) == first > 0
    assert {(r["root"], r["parts"]) for r in often if r["parts"] > 5} == {(r["root"], 5 * r["parts"]) for r in once if r["parts"] > 1}


def test_first_fit_goes_by_the_first_spot_of_a_place(spark, data, tmp_path):
    """copies on one place make no pairs."""
    folder = repeated(spark, data, {"customer": ("c_custkey", 1000)}, 6, tmp_path / "t")
    query = catalog.QUERIES["q118_first_fit"]
    rows = []
    kept, order.shared.stored = order.shared.stored, lambda df, *rest: rows.append((out := kept(df, *rest)).count()) or out
    try:
        once = query(spark, data).collect()
        first = max(rows)
        rows.clear()
        often = query(spark, folder).collect()
    finally:
        order.shared.stored = kept
    assert max(rows) == first > 0
    assert {(r["leader"], r["members"], r["last"]) for r in often} == {(r["leader"], 6 * r["members"], r["last"] + 5000) for r in once}


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_greedy_boxes_equal_greedy_match(spark, most, monkeypatch):
    """bands and regions claim what all pairs in one order do; many ties, chains across regions, crowded regions."""
    monkeypatch.setattr(score, "CELLS", 1)
    rng = random.Random(3)
    boxes = [(k, k % 2, float(rng.randrange(60)), float(rng.randrange(60)), float(rng.randrange(6, 10)), float(rng.randrange(6, 10))) for k in range(260)]
    a = spark.createDataFrame([(g, k, *box) for k, g, *box in boxes[:140]], "sheet int, a_id long, ax double, ay double, aw double, ah double")
    b = spark.createDataFrame([(g, k, *box) for k, g, *box in boxes[140:]], "sheet int, b_id long, bx double, by double, bw double, bh double")
    got = {tuple(r) for r in score.greedy_boxes(a, b, "sheet", "a_id", "b_id", 8.0, 0.2, 9, most).collect()}
    pairs = spatial.overlapping_boxes(a, b, 8.0, ["sheet"]).where("iou >= 0.2").select("sheet", "a_id", "b_id", F.round("iou", 9).alias("iou")).collect()
    used, want = set(), set()
    for r in sorted(pairs, key=lambda r: (-r["iou"], r["a_id"], r["b_id"])):
        if not {("a", r["a_id"]), ("b", r["b_id"])} & used:
            used |= {("a", r["a_id"]), ("b", r["b_id"])}
            want.add(tuple(r))
    assert got == want and len(want) > 60


def test_box_changes_equal_change_classes(spark):
    """equal boxes meet once and count as often as they are there."""
    rng = random.Random(13)
    some = lambda k: (k % 2, float(rng.randrange(300)), float(rng.randrange(300)), 8.0, float(rng.choice((8, 9))))
    a = [(k, *some(k)) for k in range(200)]
    b = [(k, g, x + rng.choice((0, 0, 3)), y, w, h) for k, g, x, y, w, h in a[:150]] + [(k + 1000, *some(k)) for k in range(200)]
    a += [(k + 5000, *row[1:]) for k, row in enumerate(a[:20])]
    b += [(k + 9000, *row[1:]) for k, row in enumerate(b[10:30])]
    old = spark.createDataFrame(a, "a_id long, sheet int, ax double, ay double, aw double, ah double")
    new = spark.createDataFrame(b, "b_id long, sheet int, bx double, by double, bw double, bh double")
    overlaps = spatial.overlapping_boxes(old, new, 9.0, ["sheet"]).where("iou >= 0.1").select("a_id", "b_id", "iou")
    want = {tuple(r) for r in score.change_classes(overlaps, old, new, "a_id", "b_id").collect()}
    found = score.box_changes(old, new, "sheet", "a_id", "b_id", 9.0, 0.1)
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want) and len({r[2] for r in rows}) == 7


def test_nearest_looks_at_few_targets_from_afar(spark, monkeypatch):
    """far points look at the near side of the targets only, whatever cells hold them; ties go by id."""
    monkeypatch.setattr(spatial, "DISTANCES", 500)
    monkeypatch.setattr(spatial, "POINTS", 7)
    rng = random.Random(6)
    p = [(k, float(rng.randrange(-900, 900)), float(rng.randrange(-900, 900))) for k in range(150)]
    t = [(k, float(rng.randrange(30)), float(rng.randrange(30))) for k in range(400)]
    found = spatial.nearest(spark.createDataFrame(p, "p long, px double, py double"), spark.createDataFrame(t, "t long, tx double, ty double"), "p", "t", 3, 2.0)
    got = {(r["p"], r["place"]): (r["distance"], r["t"]) for r in found.collect()}
    want = {}
    for k, x, y in p:
        near = sorted((((x - u) ** 2 + (y - v) ** 2) ** 0.5, n) for n, u, v in t)[:3]
        want |= {(k, n + 1): pair for n, pair in enumerate(near)}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][0] == pytest.approx(want[k][0]) for k in want)
    assert most_rows(found) < 150 * 400 / 3


def test_eliminated_rows_equal_a_loop(spark):
    """batches settle what all duels in one order do, and list fewer of them."""
    rng = random.Random(10)
    strength = [rng.random() for _ in range(400)]
    beaten: dict[int, int] = {}
    close = [(i, j) for i in range(400) for j in range(i + 1, 400) if (i * 7 - j * 7) % 400 < 60]
    for i, j in close:
        if i not in beaten and j not in beaten:
            winner, loser = (i, j) if strength[i] >= strength[j] else (j, i)
            beaten[loser] = winner
    rows = spark.createDataFrame(list(enumerate(strength)), "id long, s double")
    listed = []

    def duels(first, later):
        a, b = first.select(F.col("id").alias("i"), F.col("s").alias("a")), later.select(F.col("id").alias("j"), F.col("s").alias("b"))
        met = a.join(b, (F.col("i") < F.col("j")) & (F.pmod((F.col("i") - F.col("j")) * 7, F.lit(400)) < 60))
        out = met.select(F.when(F.expr("a >= b"), F.col("i")).otherwise(F.col("j")).alias("winner"), F.when(F.expr("a >= b"), F.col("j")).otherwise(F.col("i")).alias("loser"), F.struct("i", "j").alias("place"))
        listed.append(out.count())
        return out

    assert {r["id"]: r["by"] for r in order.eliminated_rows(rows, "id", duels).collect()} == beaten
    assert len(listed) == 4 and sum(listed) < 0.6 * len(close)
