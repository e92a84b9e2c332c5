"""Painted shapes against the same shapes pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.operators import paint
from vistaquad.sources import schema

SIZE = (40, 60)


@pytest.fixture(scope="module")
def black(spark):
    return spark.createDataFrame([("a", int(y), int(x), 0) for y, x in np.ndindex(SIZE)], "image_id string, y int, x int, v int").cache()


def shown(df):
    out = np.zeros(SIZE, int)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def grid():
    return np.mgrid[: SIZE[0], : SIZE[1]]


def lines(spark, rows):
    return spark.createDataFrame([("a", *r, z) for z, r in enumerate(rows)], "image_id string, y0 long, x0 long, y1 long, x1 long, z int")


@pytest.mark.parametrize("width", [1, 3])
def test_segments(spark, black, width):
    """Steep, flat, backwards, of one point, leaving the canvas, far beyond it on either side."""
    rows = [(2, 3, 30, 9), (5, 50, 9, 4), (20, 20, 20, 20), (39, 59, 0, 0), (-10, 30, 70, 33), (10, -(10**9), 12, 10**9), (10**9, 5, -(10**9), 55), (-50, 0, -50, 59), (100, 100, 200, 300), (7, 10**12, 7, 10**12 + 5)]
    got = shown(paint.painted(black, [paint.segments(lines(spark, rows), width, SIZE, [9], ["v"])], ["v"]))
    want = np.zeros(SIZE, int)
    for y0, x0, y1, x1 in rows:
        n = max(abs(y1 - y0), abs(x1 - x0), 1)
        steps = range(n + 1) if n < 10**4 else ()
        for s in steps:
            y, x = y0 + (2 * s * (y1 - y0) + n) // (2 * n), x0 + (2 * s * (x1 - x0) + n) // (2 * n)
            for i in range(-1, 2):
                for j in range(-1, 2):
                    if i * i + j * j <= (width / 2) ** 2 and 0 <= y + i < SIZE[0] and 0 <= x + j < SIZE[1]:
                        want[y + i, x + j] = 9
    far = np.zeros(SIZE, int)  # the two long lines are nearly straight through the canvas
    far[11 - width // 2 : 12 + width // 2] = 9
    far[:, 30 - width // 2 : 31 + width // 2] = 9
    assert (got == np.maximum(want, far)).mean() > 0.995 and (got[want == 9] == 9).all()


def test_discs_rings_and_order(spark, black):
    points = spark.createDataFrame([("a", 10, 12, 1), ("a", 14, 15, 2), ("a", -3, 30, 3), ("a", 500, 30, 4), ("b", 1, 1, 5)], "image_id string, y int, x int, z int")
    y, x = grid()
    near = lambda cy, cx: (y - cy) ** 2 + (x - cx) ** 2
    got = shown(paint.painted(black, [paint.discs(points.where("z <> 2"), 6, SIZE, [7], ["v"]), paint.discs(points.where("z = 2"), 4, SIZE, [8], ["v"])], ["v"]))
    want = np.where(near(14, 15) <= 16, 8, np.where((near(10, 12) <= 36) | (near(-3, 30) <= 36), 7, 0))
    assert (got == want).all()
    ring = shown(paint.painted(black, [paint.rings(points.where("z = 1"), 6, 2, SIZE, [7], ["v"])], ["v"]))
    assert (ring == np.where((near(10, 12) >= 25) & (near(10, 12) <= 49), 7, 0)).all()
    upside = paint.painted(black, [paint.discs(points.where("z = 2"), 4, SIZE, [8], ["v"]), paint.discs(points.where("z <> 2"), 6, SIZE, [7], ["v"])], ["v"])
    assert (shown(upside) == want).all()


def test_detection_picture(spark):
    pixels = spark.createDataFrame([("a", int(y), int(x), 1, 2, 3) for y, x in np.ndindex(SIZE)], "image_id string, y int, x int, b int, g int, r int")
    squares = spark.createDataFrame([("a", 0, [(10.7, 10.2), (40.9, 10.0), (40.0, 30.0), (10.0, 30.0)])], schema.SQUARES)
    got = {(r.y, r.x): (r.b, r.g, r.r) for r in paint.detection_picture(pixels, squares, SIZE, list("bgr")).collect()}
    assert got[10, 25] == (0, 255, 0) and got[11, 25] == (0, 255, 0) and got[10, 10] == (255, 0, 0) and got[20, 25] == (1, 2, 3) and len(got) == SIZE[0] * SIZE[1]


def test_notes_with_nulls_and_none(spark, black):
    notes = spark.createDataFrame([("a", "L", 1, 5, 5, None, None), ("a", "R", 2, None, 9, 20, 20)], "image_id string, side string, idx int, real_x long, real_y long, proj_x long, proj_y long")
    got = shown(paint.draw_reprojections(black, notes, SIZE, ["v"], radii=(2, 1), colors=([1], [2], [3], [4])))
    assert (got == 1).sum() == 13 and (got == 2).sum() == 5 and got.max() == 2
    assert not shown(paint.draw_reprojections(black, notes.limit(0), SIZE, ["v"], colors=([1], [2], [3], [4]))).any()
    assert paint.draw_reprojections(black.where(F.lit(False)), notes, SIZE, ["v"], colors=([1], [2], [3], [4])).count() == 0
