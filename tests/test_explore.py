"""Brushes, statistics, order and hulls."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.functions import collections as A
from folioscope.functions import numbers as N
from folioscope.functions import vectors as V
from folioscope.operators import brushes as B
from folioscope.operators import hulls
from folioscope.operators import ordering as R
from folioscope.operators import stats as S


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame([(i, float(i % 10), float(i // 10)) for i in range(100)], "id long, x double, y double")


def ids(df):
    return {r["id"] for r in df.collect()}


def test_brush_rules(points):
    ranges = {"x": (2, 4), "y": (3, 3)}
    both, either = ids(B.brush_axis(points, ranges, "AND")), ids(B.brush_axis(points, ranges, "OR"))
    assert both == {32, 33, 34} and both < either
    assert ids(B.brush_axis(points, {})) == set(range(100))
    for brush in (lambda: B.brush_axis(points, ranges, "XOR"), lambda: B.brush_strum(points, [], 1, "x"),
                  lambda: B.brush_angle(points, [], 1, "and")):
        with pytest.raises(ValueError):
            brush()


def test_plain_range_reaches_the_scan(spark, points, tmp_path):
    points.write.parquet(str(tmp_path / "p"))
    brushed = B.brush_axis(spark.read.parquet(str(tmp_path / "p")), {"x": (2, 4)}).select("id")
    plan = brushed._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(x,2.0)" in plan


def test_strum_is_strict(spark):
    rows = spark.createDataFrame([(0, 0.0, 0.0), (1, 10.0, 10.0), (2, 5.0, 5.0)], "id long, a double, b double")
    # places: 11, 1 and 6; the line runs from height 6 to height 12 in the middle of the axes
    strum = B.Strum("a", "b", (50.0, 6.0), (50.0, 12.0), 100.0)
    assert ids(B.brush_strum(rows, [strum], 10.0)) == {0}


def test_ordinal_brush(spark):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate("aaabbc")], "id long, c string")
    domain = B.ordinal_domain(rows, "c")
    assert [r["value"] for r in domain.orderBy("place").collect()] == ["c", "b", "a"]
    assert ids(B.brush_axis(rows, {"c": (0, 1)}, ordinal={"c": domain})) == {3, 4, 5}


def test_golden_statistics(spark):
    one = spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3])], "id long, v double").withColumn("g", F.lit(1))
    spread = S.stats_variance(one, "v").first()
    assert spread["dev_pop"] == pytest.approx(0.816496580927726) and spread["var_pop"] == pytest.approx(2 / 3)
    scores = [r["zscore"] for r in S.standard_scores(one, "v", ["g"]).orderBy("id").collect()]
    assert scores == pytest.approx([-1.224744871391589, 0, 1.224744871391589])
    four = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4]], "v double")
    assert S.stats_median(four, "v").first()["median"] == 2.5


def test_moving_average_across_blocks(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(1, 41)], "id long, v double")
    found = R.moving_avg(rows, [F.col("id")], "v", 3, block=4).orderBy("id").collect()
    assert [r["moving_avg"] for r in found] == [float(i) for i in range(2, 40)]


def test_global_rank_and_prefix_sum(spark):
    rows = spark.range(500).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(50)).alias("v"))
    ranked = R.global_rank(rows, [F.col("v"), F.col("id")]).collect()
    expected = sorted((r["v"], r["id"]) for r in ranked)
    assert [(r["v"], r["id"]) for r in sorted(ranked, key=lambda r: r["rank"])] == expected
    running = {r["id"]: r["running"] for r in R.prefix_sum(rows, [F.col("id")], "id").collect()}
    assert running[499] == 499 * 500 // 2 and running[10] == 55


def test_spearman_of_monotone_columns(spark):
    rows = spark.createDataFrame([(float(i), float(i**3)) for i in range(20)], "x double, y double")
    assert S.corr_spearman(rows, "x", "y").first()["corr"] == pytest.approx(1.0)


def test_numbers(spark):
    row = spark.range(1).select(
        N.round_to(F.lit(2.345), 2), N.number_range(F.lit(1).cast("long"), F.lit(4).cast("long")),
        N.number_range(F.lit(4).cast("long"), F.lit(4).cast("long")),
        N.slope(F.lit(1.0), F.lit(1.0), F.lit(1.0), F.lit(2.0)),
        V.haversine(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.lit(0.0)),
        *N.line_intersection((F.lit(0.0), F.lit(0.0)), (F.lit(2.0), F.lit(2.0)), (F.lit(0.0), F.lit(2.0)), (F.lit(2.0), F.lit(0.0))),
    ).first()
    assert row[1] == [1, 2, 3] and row[2] == [] and row[3] is None
    assert row[4] == pytest.approx(np.pi * 6371) and (row[5], row[6]) == (1.0, 1.0)


def test_array_helpers(spark):
    items = F.array(*[F.lit(x) for x in [3, 1, 3, 2]])
    row = spark.range(1).select(
        A.last_index_of(items, F.lit(3)), A.index_of(items, F.lit(9)), A.sorted_index(F.array(F.lit(1), F.lit(3)), F.lit(2)),
        A.difference(items, F.array(F.lit(1))), A.max_by(items, lambda x: x % 3), A.initial(items, 9), A.rest(items, 9),
        A.last_n(items, 9), A.find(items, lambda x: x < 3),
    ).first()
    assert tuple(row) == (2, -1, 1, [3, 3, 2], 2, [], [], [3, 1, 3, 2], 1)


def test_hull(spark):
    square = [("s", float(x), float(y)) for x, y in [(0, 0), (2, 0), (2, 2), (0, 2), (1, 1), (2, 2)]]
    three = [("t", 0.0, 0.0), ("t", 1.0, 1.0), ("t", 2.0, 0.0)]
    rows = hulls.convex_hull(spark.createDataFrame(square + three, "g string, x double, y double"), ["g"])
    found = {}
    for r in rows.orderBy("g", "pos").collect():
        found.setdefault(r["g"], []).append((r["x"], r["y"]))
    assert found["s"] == [(0, 0), (2, 0), (2, 2), (0, 2)] and sorted(found["t"]) == sorted(p[1:] for p in three)


def test_hull_holds_all_points(spark):
    cloud = np.random.default_rng(1).normal(size=(400, 2))
    rows = spark.createDataFrame([(1, float(x), float(y)) for x, y in cloud], "g int, x double, y double").repartition(5)
    corners = np.array([(r["x"], r["y"]) for r in hulls.convex_hull(rows, ["g"]).orderBy("pos").collect()])
    edges = np.roll(corners, -1, axis=0) - corners
    side = edges[:, None, 0] * (cloud[None, :, 1] - corners[:, None, 1]) - edges[:, None, 1] * (cloud[None, :, 0] - corners[:, None, 0])
    assert (side >= -1e-9).all()


def test_hulls_equal_those_of_all_points_at_once(spark):
    rng = np.random.default_rng(6)
    groups = {
        0: rng.normal(size=(500, 2)), 1: rng.integers(0, 4, (300, 2)).astype(float), 2: np.array([[0.0, 0], [9, 0], [0, 9], [1, 1], [2, 3]]),
        3: np.stack([np.arange(50.0), 2 * np.arange(50.0)], axis=1), 4: np.repeat([[1.0, 2.0]], 30, axis=0), 5: 1e9 + rng.normal(size=(200, 2)),
        6: np.array([[0.0, 0], [5, 1], [2, 7]]), 7: rng.normal(size=(300, 2)) * [1e-6, 1e6],
    }
    rows = spark.createDataFrame([(g, float(x), float(y)) for g, own in groups.items() for x, y in own], "g int, x double, y double")
    found = {}
    for r in hulls.convex_hull(rows.repartition(6), ["g"]).orderBy("g", "pos").collect():
        found.setdefault(r["g"], []).append((r["x"], r["y"]))
    assert found == {g: [tuple(p) for p in hulls.hull_points(own).tolist()] for g, own in groups.items()}
    seen = hulls._outermost(rows, ["g"]).join(rows, "g").filter(~hulls._inside(F.col("ring"), F.col("x"), F.col("y")))
    assert seen.filter("g = 0").count() < 60


@pytest.mark.parametrize("cells", [2000, 20])
def test_product_shuffles_matrices_instead_of_products(spark, monkeypatch, cells):
    from folioscope.operators import matrix as M

    monkeypatch.setattr(M, "TILE_CELLS", cells)
    rng = random.Random(4)

    def drawn(height, width):
        rows = [(rng.randrange(height), rng.randrange(width), rng.choice([None, 0.0, 2.0, -1.5])) for _ in range(60)]
        return [*rows, (None, 1, 1.0), (1, None, 1.0), (2, 0, float("nan"))]

    a, b = drawn(8, 3), drawn(3, 9)
    want = {}
    for i, k, x in a:
        for l, j, y in b:
            if k is not None and k == l:
                want.setdefault((i, j), []).append(None if x is None or y is None else x * y)
    want = {c: None if all(p is None for p in ps) else sum(p for p in ps if p is not None) for c, ps in want.items()}
    tables = [spark.createDataFrame(rows, "i long, j long, v double") for rows in (a, b)]
    product = M.multiply(*tables)
    assert "FlatMapCoGroupsInArrow" in product._jdf.queryExecution().toString()
    found = {(r["i"], r["j"]): r["v"] for r in product.collect()}
    assert found.keys() == want.keys()
    for c, v in want.items():
        assert (found[c] is None) if v is None else found[c] == pytest.approx(v, nan_ok=True)
    square = {(r["i"]): r["v"] for r in M.product_diagonal(*tables).collect()}
    assert set(square) == {i for i, j in want if i == j and i is not None}
    few = [spark.createDataFrame([(1, 5, 2.0), (2, 6, 3.0)], "i long, j long, v double") for _ in range(2)]
    assert M.multiply(*few).count() == 0
