"""Views of several cameras: overlapping pairs against all pairs compared, and mosaics against plain layers."""

import numpy as np
from pyspark.sql import functions as F

from vistaquad.functions.geometry import homography
from vistaquad.operators import footprints
from vistaquad.plans import calibrate
from vistaquad.sources import schema
from vistaquad.sources.images import row_of

QUADS = "camera_id long, corners array<struct<x:double,y:double>>"


def apart(a, b):
    for one, other in ((a, b), (b, a)):
        for k in range(4):
            d = one[(k + 1) % 4] - one[k]
            p, q = one @ [d[1], -d[0]], other @ [d[1], -d[0]]
            if p.max() < q.min() or q.max() < p.min():
                return True
    return False


def test_pairs_of_random_quads(spark):
    rng, quads = np.random.default_rng(3), []
    for _ in range(120):
        angles, middle, size = np.sort(rng.uniform(0, 2 * np.pi, 4)), rng.uniform(-80, 560, 2), rng.uniform(5, 90)
        quads.append(middle + size * np.stack([np.cos(angles), np.sin(angles)], 1))
    quads += [np.array([(600.0, 0), (640, 0), (640, 40), (600, 40)]), np.array([(640.0, 40), (700, 40), (700, 90), (640, 90)])]  # touch in a corner
    df = spark.createDataFrame([(i, [tuple(map(float, p)) for p in q]) for i, q in enumerate(quads)] + [(999, None)], QUADS)
    on = [i for i, q in enumerate(quads) if q[:, 0].max() >= 0 and q[:, 0].min() <= 699 and q[:, 1].max() >= 0 and q[:, 1].min() <= 499]
    want = {(i, j) for i in on for j in on if i < j and not apart(quads[i], quads[j])}
    for cell in (16, 64, 1000):
        got = [tuple(r) for r in footprints.overlapping(df, 700, 500, cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (120, 121) in want and footprints.overlapping(df.limit(0), 700, 500).count() == 0


def test_pairs_are_judged_once(spark):
    """No pair is shuffled after it was found, unless a camera has several footprints; those give a pair once, too."""
    square = lambda x: [(x, 0.0), (x + 200, 0.0), (x + 200, 200.0), (x, 200.0)]
    df = spark.createDataFrame([(1, square(0.0)), (2, square(50.0)), (3, square(100.0))], QUADS)
    found = footprints.overlapping(df, 700, 500)
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = [(1, 2), (1, 3), (2, 3)]
    assert sorted(map(tuple, found.collect())) == pairs == sorted(map(tuple, footprints.overlapping(df.union(df), 700, 500).collect()))


def test_a_horizon_has_no_footprint(spark):
    h = {"flat": [1, 0, 5, 0, 1, 7, 0, 0, 1], "tilted": [1, 0, 0, 0, 1, 0, -0.05, 0, 1], "none": None}
    rows = [(n, 10, 30) for n in h]
    by = F.when(F.col("camera_id") == "flat", homography(h["flat"])).when(F.col("camera_id") == "tilted", homography(h["tilted"]))
    images = spark.createDataFrame(rows, "image_id string, height int, width int")
    found = footprints.footprints(images, images.select(F.col("image_id").alias("camera_id")).withColumn("h", by)).collect()
    assert [(r.camera_id, [tuple(p) for p in r.corners]) for r in found] == [("flat", [(5, 7), (34, 7), (34, 16), (5, 16)])]


def test_mosaic_of_layers(spark):
    rng, rows, layers = np.random.default_rng(5), [], np.zeros((4, 30, 40), int)
    for pos in range(4):
        a = rng.integers(0, 256, (12, 15)) * (rng.random((12, 15)) < 0.7)
        y0, x0 = (2 + 5 * pos, 3 + 7 * pos)
        layers[pos, y0 : y0 + 12, x0 : x0 + 15] = a
        rows += [(pos, int(y0 + y), int(x0 + x), int(a[y, x])) for y, x in np.ndindex(a.shape)]
    lit = layers > 10
    want = np.take_along_axis(layers, lit.argmax(axis=0)[None], 0)[0] * lit.any(axis=0)
    ys, xs = np.nonzero(lit.any(axis=0))
    want = want[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
    df = spark.createDataFrame(rows, "pos int, y int, x int, v int").repartition(4)
    got = np.full(want.shape, -1)
    for r in footprints.mosaic(df, ["v"]).collect():
        assert got[r.y, r.x] == -1
        got[r.y, r.x] = r.v
    assert (got == want).all()
    assert footprints.mosaic(df.withColumn("v", F.lit(10)), ["v"]).count() == 0 and footprints.mosaic(df.limit(0), ["v"]).count() == 0


def test_three_cameras(spark):
    """Three views side by side, of which neighbours overlap: pairs are found, stitched together in one job, and all in one."""
    arrays = [np.full((40, 50, 3), 60 + 60 * k, np.uint8) for k in range(3)]
    images = spark.createDataFrame([row_of(f"c{k}", a) for k, a in enumerate(arrays)], schema.IMAGES)
    move = F.substring("image_id", 2, 1).cast("double") * 35.0
    h = F.struct(*(F.lit(float(v)).alias(n) if n != "h02" else move.alias(n) for n, v in zip(("h00", "h01", "h02", "h10", "h11", "h12", "h20", "h21", "h22"), (1, 0, 0, 0, 1, 0, 0, 0, 1), strict=True)))
    done = images.select(F.col("image_id").alias("camera_id"), h.alias("h"))
    seen = calibrate.views(images, done, 130, 45).cache()
    pairs = calibrate.found_pairs(images, done, 130, 45)
    assert sorted(map(tuple, pairs.collect())) == [("c0", "c1"), ("c1", "c2")]
    got = calibrate.stitched(seen, pairs, "first_wins").groupBy("pair_id", "b").count().collect()
    assert {(r.pair_id, r.b): r["count"] for r in got} == {("c0+c1", 60): 2000, ("c0+c1", 120): 1400, ("c1+c2", 120): 2000, ("c1+c2", 180): 1400}
    order = images.select("image_id", (-F.substring("image_id", 2, 1).cast("int")).alias("pos"))
    whole = calibrate.mosaic(seen, order).groupBy("g").agg(F.count("*").alias("n"), F.min("x").alias("x")).collect()
    assert {(r.g, r.n, r.x) for r in whole} == {(60, 1400, 0), (120, 1400, 35), (180, 2000, 70)}


def test_pairs_are_dealt_out_and_compiled(spark):
    """The join of pairs broadcasts nothing and has more than one task; the JVM compiles no method of over 8000 bytes."""
    import re

    rows = [(k, [(k % 7 + x, k % 5 + y) for x, y in ((0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0))]) for k in range(300)]  # all in one cell
    found = footprints.overlapping(spark.createDataFrame(rows, QUADS).coalesce(1), 700, 500)
    assert found.count() == 300 * 299 // 2 and found.select(F.spark_partition_id()).distinct().count() > 1
    assert "BroadcastExchange" not in found._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = found.selectExpr("*")._jdf.queryExecution()
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", spark._jvm.PythonSQLUtils.explainString(plan, "codegen"))]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sizes and max(sizes) <= 8000
