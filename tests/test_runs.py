"""Masks as runs against the same masks pixel by pixel."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.operators import raster, runs, stitch

SHAPE = (9, 40)


@pytest.fixture(scope="module")
def masks(spark):
    """Three images, two masks each: scattered, in blocks, one of them empty."""
    rng, both = np.random.default_rng(2), {}
    for name, share in (("a", 0.5), ("b", 0.9), ("c", 0.0)):
        both[name] = [rng.random(SHAPE) < share, np.repeat(rng.random((SHAPE[0], 8)) < 0.6, 5, axis=1)]
    rows = [(n, int(y), int(x), bool(m[0][y, x]), bool(m[1][y, x]), 1, 2) for n, m in both.items() for y, x in np.ndindex(SHAPE)]
    pixels = spark.createDataFrame(rows, "image_id string, y int, x int, one boolean, two boolean, start int, _run int").repartition(5)
    return both, pixels.cache(), [runs.runs_of(pixels, F.col(c)).cache() for c in ("one", "two")]


def as_masks(found):
    out = {}
    for r in found.collect():
        own = out.setdefault(r.image_id, np.zeros(SHAPE, int))
        own[r.y, r.start : r.end] += 1
        assert r.start < r.end
    return out


def test_there_and_back(masks):
    both, pixels, (one, _) = masks
    got = as_masks(one)
    assert "c" not in got and all((got[n] == both[n][0]).all() for n in "ab")
    assert one.count() < pixels.where("one").count()
    assert sorted(map(tuple, runs.pixels_of(one).collect())) == sorted((r.image_id, r.y, r.x) for r in pixels.where("one").collect())
    repeated = runs.runs_of(pixels.union(pixels), F.col("one"))
    assert sorted(map(tuple, repeated.collect())) == sorted(map(tuple, one.collect()))


@pytest.mark.parametrize("name", ["union", "intersection", "difference", "one"])
def test_algebra(masks, name):
    both, _, (one, two) = masks
    by_pixel = {"union": np.logical_or, "intersection": np.logical_and, "difference": lambda a, b: a & ~b, "one": np.logical_xor}[name]
    found = runs.combined([one, two], lambda a, b: a != b) if name == "one" else getattr(runs, name)(one, two)
    got = as_masks(found)
    for n, (a, b) in both.items():
        assert (got.get(n, np.zeros(SHAPE, int)) == by_pixel(a, b)).all(), n
    # One form only: no run touches the next.
    ends = {(r.image_id, r.y, r.end) for r in found.collect()}
    assert not ends & {(r.image_id, r.y, r.start) for r in found.collect()}


def test_runs_that_overlap_or_are_empty(spark):
    messy = spark.createDataFrame([("a", 0, 1, 5), ("a", 0, 3, 8), ("a", 0, 8, 9), ("a", 0, 20, 20), ("a", 1, 2, 3)], "image_id string, y int, start int, end int")
    none = messy.limit(0)
    assert sorted(map(tuple, runs.union(messy, none).collect())) == [("a", 0, 1, 9), ("a", 1, 2, 3)]
    assert runs.intersection(messy, none).count() == 0 and runs.boxes(none).count() == 0


def test_boxes_and_spans(masks):
    _, pixels, (one, _) = masks
    order = ["image_id", "y_min", "y_max", "x_min", "x_max", "n"]
    want, got = (sorted(map(tuple, df.select(*order, F.round("x_mean", 9), F.round("y_mean", 9)).collect())) for df in (raster.boxes(pixels, F.col("one")), runs.boxes(one)))
    assert got == want
    spans = pixels.where("one").groupBy("image_id", "y").agg(F.min("x").alias("x_start"), F.max("x").alias("x_end"))
    assert sorted(map(tuple, runs.spans(one).collect())) == sorted(map(tuple, spans.collect()))


def test_a_sweep_has_one_exchange(masks):
    """Both masks go by (image, row) once; ends, sweep and runs need no other exchange."""
    _, _, (one, two) = masks
    plan = runs.union(one, two)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("InMemoryTableScan")[0].count("Exchange") <= 2 and "SinglePartition" not in plan


def test_seams_without_overlap(spark):
    """Pairs with an overlap, side by side without one, with one image black, and with both black: as the pixel mask."""
    rng = np.random.default_rng(6)
    sides = {"over": (slice(0, 30), slice(18, 40)), "apart": (slice(0, 12), slice(30, 40)), "single": (slice(5, 20), slice(0, 0)), "black": (slice(0, 0), slice(0, 0))}

    def image(n):
        rows = []
        for pair, cut in sides.items():
            a = np.zeros(SHAPE, int)
            a[:, cut[n]] = rng.integers(50, 256, a[:, cut[n]].shape)
            rows += [(pair, int(y), int(x), int(a[y, x])) for y, x in np.ndindex(SHAPE)]
        return spark.createDataFrame(rows, "pair_id string, y int, x int, v int")

    by = ("pair_id",)
    pairs = raster.pairs(image(0), image(1), ["v"]).cache()
    costs = raster.blur(raster.difference(pairs, ["v"]), "diff", by)
    one, two = (runs.runs_of(costs, F.col(f"mask{n}"), by) for n in (1, 2))
    extent = pairs.groupBy("pair_id", "y").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end"))
    got = runs.pixels_of(runs.seam_runs(one, two, costs, extent, by), by)
    want = stitch.seam_mask(pairs, ["v"]).where("seam = 1").select("pair_id", "y", "x")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and want.count() > 500
