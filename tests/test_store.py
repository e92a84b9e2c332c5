"""Pixel tables stored in bands: the same pixels, and plans without an exchange of pixels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.operators import raster, stitch
from vistaquad.sources import store

BY, BANDS = ("pair_id",), ("pair_id", "band")
SIZES = {"a": (150, 20), "b": (64, 9), "c": (66, 5), "d": (1, 30)}


@pytest.fixture(scope="module")
def sides(spark):
    rng, made = np.random.default_rng(4), []
    for n in (0, 1):
        rows = []
        for pair, shape in SIZES.items():
            a = rng.integers(0, 256, shape)
            a[:, (shape[1] * 2 // 3 if n == 0 else 0) : (shape[1] if n == 0 else shape[1] // 4)] = 0
            if pair == "b":  # no overlap
                a[:, slice(3, None) if n == 0 else slice(0, 6)] = 0
            rows += [(pair, int(y), int(x), int(a[y, x])) for y, x in np.ndindex(shape)]
        made.append(spark.createDataFrame(rows, "pair_id string, y int, x int, v int").cache())
    return made


@pytest.fixture(scope="module")
def pairs(sides):
    one, two = (store.stored(side, "side", 4) for side in sides)
    return raster.pairs(*sides, ["v"]), raster.pairs(one, two, ["v"], BANDS)


def same(got, want):
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_bands_hold_each_pixel_once(spark, sides):
    held = store.stored(sides[0], "side", 3)
    same(store.owned(held), sides[0])
    assert held.where("pair_id = 'a' and band = 1").agg(F.min("y"), F.max("y")).first() == (62, 129)
    assert not spark.catalog.listTables() or all(not t.name.startswith("side_") for t in spark.catalog.listTables())


def test_operators_over_bands(pairs):
    plain, bands = pairs
    same(store.owned(raster.difference(bands, ["v"])), raster.difference(plain, ["v"]))
    same(store.owned(raster.blur(raster.difference(bands, ["v"]), "diff", BANDS)), raster.blur(raster.difference(plain, ["v"]), "diff", BY))
    same(store.owned(stitch.seam_mask(bands, ["v"], BANDS, BY)).select("pair_id", "y", "x", "seam"), stitch.seam_mask(plain, ["v"]).select("pair_id", "y", "x", "seam"))
    same(store.owned(stitch.feather(bands, ["v"], BANDS, image=BY)), stitch.feather(plain, ["v"]))
    same(store.owned(stitch.blend(bands, ["v"], BANDS)), stitch.blend(plain, ["v"]))


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Bucketed: true") >= 2
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_no_exchange_of_pixels(spark, sides):
    """Joins, differences, both axes of the blur, seams and blends read buckets; only sums of a whole pair are exchanged."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # else the small tables of a test are broadcast
        bands = raster.pairs(*(store.stored(side, "side", 4) for side in sides), ["v"], BANDS)
        for df in (raster.difference(bands, ["v"]), raster.blur(raster.difference(bands, ["v"]), "diff", BANDS), stitch.seam_rows(bands, ["v"], BANDS), stitch.blend(bands, ["v"], BANDS)):
            assert not exchanges(df)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1k")  # pixels can't be broadcast, a row for each pair can
        bands = raster.pairs(*(store.stored(side, "side", 4) for side in sides), ["v"], BANDS)
        sums = exchanges(stitch.feather(bands, ["v"], BANDS, image=BY))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    assert [line for line in sums if "band" not in line] and not any("y#" in line or "x#" in line for line in sums), sums
