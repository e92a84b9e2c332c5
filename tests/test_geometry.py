"""Closed-form cases of points, quads and rasters."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.functions import geometry, quads
from vistaquad.operators import points, raster, stitch

IDENTITY = [1, 0, 0, 0, 1, 0, 0, 0, 1]


def quad(corners):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in corners))


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_projection(spark):
    p = spark.createDataFrame([("c", 0, 0.1, 7.0, 0.1, 7.0)], "camera_id string, idx int, src_x double, src_y double, dst_x double, dst_y double")
    row = points.project_points(p.withColumn("h", geometry.homography(IDENTITY))).first()
    assert (row.u, row.v) == (float(np.float32(0.1)), 7.0)
    moved = p.withColumn("h", geometry.homography([1, 0, 3, 0, 1, 4, 0, 0, 1]))
    assert points.mean_error(points.reprojection(moved)).first().mean_error == pytest.approx(5)


def test_vanishing_denominator(spark):
    h = geometry.homography([1, 0, 0, 0, 1, 0, 1, 0, 0])
    u, v = geometry.project(h, F.lit(0.0), F.lit(2.0))
    assert one(spark, F.isnan(u), v)[:] == (True, math.inf)
    assert one(spark, *geometry.project(h, F.lit(0.0), F.lit(2.0), "cv"))[:] == (0.0, 0.0)
    assert one(spark, *geometry.project(h, F.lit(None).cast("double"), F.lit(2.0), "cv"))[:] == (None, None)


def test_angles(spark):
    at = lambda *v: one(spark, geometry.angle(*map(F.lit, map(float, v))))[0]
    assert at(1, 0, 0, 2) == pytest.approx(90) and at(1, 0, -1, 0) == pytest.approx(180) and math.isnan(at(0, 0, 1, 1))


def test_improvement_of_nothing(spark):
    assert one(spark, *geometry.improvement(F.lit(0.0), F.lit(0.0)))[:] == (0.0, 0.0)


@pytest.mark.parametrize("turn", [0, 0.3, 2.0])
def test_metric_of_squares(spark, turn):
    c, s = math.cos(turn), math.sin(turn)
    q = quad([(x * c - y * s + 5, x * s + y * c - 3) for x, y in ((0, 0), (100, 0), (100, 100), (0, 100))])
    assert one(spark, quads.metric(q), quads.metric(q, compat=False))[:] == pytest.approx((300, 0), abs=1e-6)


def test_metric_of_rectangles(spark):
    value = [one(spark, quads.metric(quad([(0, 0), (100, 0), (100, h), (0, h)])))[0] for h in (50, 1)]
    assert value == pytest.approx([250, 201])


def test_corner_order(spark):
    want = [(0, 0), (10, 0), (10, 10), (0, 10)]
    got = one(spark, *(quads.sort_corners(quad(p)) for p in itertools.permutations(want)))
    assert all([(p.x, p.y) for p in q] == want for q in got)
    diamond = [(50, 0), (100, 50), (50, 100), (0, 50)]
    assert [(p.x, p.y) for p in one(spark, quads.sort_corners(quad(diamond)))[0]] == diamond


def test_roles_and_holdout(spark):
    from vistaquad.sources.points import inline_points, roles

    n = 41
    p = inline_points(spark, {"c": {"src_points": [(i, i) for i in range(n)], "dst_points": [(i, i) for i in range(n)]}})
    r = roles(spark, {"c": {"optimization": [0, 4, 4, 5, 6, 7, 8, 9, 40]}})
    assert points.select_role(p, r, "optimization").count() == 9
    assert points.holdout(p, r, "optimization").count() == 33
    with pytest.raises(ValueError):
        inline_points(spark, {"c": {"src_points": []}})


def test_pooled_error_is_weighted_by_count(spark):
    side = lambda v: spark.createDataFrame([("p", float(x)) for x in v], "pair_id string, error double")
    assert points.pooled_error(side([0]), side([4, 4, 4])).first().mean_error == 3


def pixels(spark, rows):
    return spark.createDataFrame([("p", y, x, int(v)) for y, row in enumerate(rows) for x, v in enumerate(row)], "pair_id string, y int, x int, v int")


def as_rows(df):
    found = {(r.y, r.x): r.v for r in df.collect()}
    h, w = max(y for y, _ in found) + 1, max(x for _, x in found) + 1
    return [[found[y, x] for x in range(w)] for y in range(h)]


def test_blend(spark):
    rows = raster.pairs(pixels(spark, [[200, 200, 0]]), pixels(spark, [[101, 0, 50]]), ["v"])
    assert as_rows(stitch.blend(rows, ["v"])) == [[150, 100, 25]]
    assert as_rows(stitch.blend(rows, ["v"], compat=False)) == [[150, 200, 50]]


def test_blur_and_gray(spark):
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (7, 9))
    p = np.pad(a, 2, mode="reflect")
    k = np.array([1, 4, 6, 4, 1])
    want = [[int((k @ p[y : y + 5, x : x + 5] @ k + 128) // 256) for x in range(9)] for y in range(7)]
    got = raster.blur(pixels(spark, a), "v", ("pair_id",)).select("y", "x", F.col("blur").alias("v"))
    assert as_rows(got) == want
    assert one(spark, raster.gray(F.lit(255), F.lit(0), F.lit(0)), raster.gray(F.lit(255), F.lit(0), F.lit(0), True))[:] == (29, 76)


def test_seams(spark):
    flat = [[100] * 12] * 6
    tie = stitch.seam_mask(raster.pairs(pixels(spark, flat), pixels(spark, flat), ["v"]), ["v"])
    assert sum(r.seam for r in tie.collect()) == 0  # the leftmost of equal columns, so nothing is left of it
    narrow = [[0] * 6 + [100] * 6] * 6
    wide = stitch.seam_mask(raster.pairs(pixels(spark, flat), pixels(spark, narrow), ["v"]), ["v"])
    assert {(r.x, r.seam) for r in wide.collect()} == {(x, int(x < 6)) for x in range(12)}
    left, right = [[9] * 10 + [0] * 20] * 6, [[0] * 20 + [9] * 10] * 6
    apart = stitch.seam_mask(raster.pairs(pixels(spark, left), pixels(spark, right), ["v"]), ["v"])
    assert {(r.x, r.seam) for r in apart.collect()} == {(x, int(x < 14)) for x in range(30)}


def test_first_wins_crops(spark):
    a, b = [[0, 0, 0], [0, 50, 0]], [[0, 0, 0], [0, 90, 90]]
    rows = raster.pairs(pixels(spark, a), pixels(spark, b), ["v"], how="full")
    assert as_rows(stitch.first_wins(rows, ["v"])) == [[50, 90]]


def test_fixed_overlap(spark):
    a, b = [[1] * 200], [[0] * 100 + [2] * 100]
    out = as_rows(stitch.fixed_overlap(pixels(spark, a), pixels(spark, b), ["v"], 200))
    assert out == [[1] * 200 + [2] * 100]
    with pytest.raises(ValueError):
        stitch.fixed_overlap(pixels(spark, a), pixels(spark, b), ["v"], 50)
