"""Estimation, refinement, search, warps and detection on data with known answers."""

import numpy as np
import pytest
from plain import mapped, multiband_blended, warped
from pyspark.sql import functions as F

from vistaquad.functions.geometry import ENTRIES, homography, similarity
from vistaquad.operators import detect, estimate, refine, report, rules, search, warp
from vistaquad.sources import schema
from vistaquad.sources.images import encode_png, explode, pack, read_images, row_of

TRUE = np.array([1.1, 0.05, 12, -0.03, 0.95, 7, 1e-4, -5e-5])


def marks(spark, n=41, noise=0.0, outliers=0, seed=3):
    rng = np.random.default_rng(seed)
    src = rng.uniform(0, 400, (n, 2))
    dst = mapped(TRUE, src) + rng.normal(0, noise, (n, 2))
    dst[:outliers] += 80
    return spark.createDataFrame([("c", i, *map(float, (*s, *d))) for i, (s, d) in enumerate(zip(src, dst, strict=True))], schema.POINTS)


def params(row):
    return np.array([row.h[n] for n in ENTRIES[:8]])


def error(p):
    grid = np.stack(np.meshgrid(np.arange(0, 400, 40), np.arange(0, 400, 40)), -1).reshape(-1, 2).astype(float)
    return np.linalg.norm(mapped(p, grid) - mapped(TRUE, grid), axis=1).max()


def test_least_squares_recovers(spark):
    assert error(params(estimate.least_squares(marks(spark)).first())) < 1e-2
    assert estimate.least_squares(marks(spark, n=3)).first().h is None


def test_ransac_leaves_outliers(spark):
    assert error(params(estimate.ransac(marks(spark, noise=0.3, outliers=8)).first())) < 3


def test_bounds_and_stages():
    p = np.array([1, 0, 10, 0, 1, 20, 0, 0], float)
    b = rules.bounds_of(p, "strict")
    assert b == pytest.approx(np.array([[0.9, 1.1], [-0.1, 0.1], [-40, 60], [-0.1, 0.1], [0.9, 1.1], [-30, 70], [-0.001, 0.001], [-0.001, 0.001]]))
    for mode in ("foo", ["strict"]):
        with pytest.raises(ValueError):
            rules.bounds_of(p, mode)
    steps = refine.stages(5)
    assert [s[2] for s in steps] == [0.9, 0.5, 0.4, 0.4, 0.4] and [s[1] for s in steps] == ["adaptive", "strict", "none", "none", "none"]


@pytest.mark.parametrize("method", ["Powell", "L-BFGS-B", "BFGS", "TNC"])
@pytest.mark.parametrize("mode", ["adaptive", "strict"])
def test_refinement_finds_the_least_objective(spark, method, mode):
    """Exact anchors: the least objective is 0, and it lies within the bounds."""
    start = spark.range(1).select(F.lit("c").alias("camera_id"), homography([*TRUE * 1.02, 1]).alias("h"))
    none = spark.createDataFrame([], f"camera_id string, corners {schema.QUAD}")
    src = np.array([[r.src_x, r.src_y, r.dst_x, r.dst_y] for r in marks(spark, 20).collect()])
    before = np.linalg.norm(mapped(TRUE * 1.02, src[:, :2]) - src[:, 2:], axis=1).sum()
    done = refine.refine(start, none, marks(spark, 20), [(method, mode, 1.0)], turns=12).first()
    b = rules.bounds_of(TRUE * 1.02, mode)
    x = params(done)
    assert done.objective < 0.05 * before and (x >= b[:, 0] - 1e-9).all() and (x <= b[:, 1] + 1e-9).all()
    assert done.objective == pytest.approx(np.linalg.norm(mapped(x, src[:, :2]) - src[:, 2:], axis=1).sum(), rel=1e-9)


def test_refine_reports_failures(spark):
    start = spark.range(1).select(F.lit("c").alias("camera_id"), homography([*TRUE * 1.02, 1]).alias("h"))
    none = spark.createDataFrame([], f"camera_id string, corners {schema.QUAD}")
    done = refine.refine(start, none, marks(spark), [("Powell", "adaptive", 1.0)]).first()
    assert done.error is None and error(params(done)) < error(TRUE * 1.02)
    for step in (("Powell", "foo", 1.0), ("foo", "none", 1.0)):
        bad = refine.refine(start, none, marks(spark), [step]).first()
        assert bad.h is None and "ValueError" in bad.error
    lost = refine.refine(start.withColumn("h", F.when(F.col("camera_id") != "c", F.col("h"))), none, marks(spark), [("TNC", "none", 1.0)]).first()
    assert lost.h is None and "no first homography" in lost.error
    alone = refine.refine(start, none, marks(spark).limit(0), [("TNC", "none", 1.0)], turns=1).first()
    assert params(alone) == pytest.approx(TRUE * 1.02) and alone.objective == 0


def test_search_fails_one_level_and_finds_the_best(spark):
    start = spark.range(1).select(F.lit("c").alias("camera_id"), homography([*TRUE * 1.01, 1]).alias("h"))
    square = spark.createDataFrame([("c", [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)])], f"camera_id string, corners {schema.QUAD}")
    trials = search.sample(start, 6)
    assert trials.collect() == search.sample(start.repartition(3), 6).collect()
    one = spark.createDataFrame([("c", 99, 1, [("Powell", "strict", 0.5)])], schema.TRIALS)
    results = search.run(search.balanced(start).union(one), start, square, marks(spark, 12), marks(spark, 12), turns=3).cache()
    by = {r.trial_id: r for r in results.collect()}
    assert by[0].success and not by[99].success and by[99].error
    assert report.best(results).first().trial_id == 0
    assert report.best(results.where("not success")).count() == 0


def test_best_configuration_and_sweep(spark):
    stages = [("Powell", "strict", 0.5), ("TNC", "none", 0.25)]
    rows = [("c", 3, 2, stages, True, 2.0), ("c", 5, 2, stages[::-1], True, 1.0), ("c", 6, 2, stages, False, None), ("d", 1, 2, stages, False, None)]
    results = spark.createDataFrame(rows, f"camera_id string, trial_id int, levels int, stages {schema.STAGES}, success boolean, optimized_error double")
    configs = search.best_configs(results)
    r = configs.collect()
    assert len(r) == 1 and (r[0].name, r[0].levels, r[0].methods, r[0].bounds_modes, r[0].weights, r[0].square_area) == ("Best-5", 2, ["TNC", "Powell"], ["none", "strict"], [0.25, 0.5], 2000)
    assert [tuple(x) for x in search.of_configs(configs).first().stages] == stages[::-1]
    start = spark.range(1).select(F.lit("c").alias("camera_id"), homography([*TRUE * 1.01, 1]).alias("h"))
    square = spark.createDataFrame([("c", [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0)])], f"camera_id string, corners {schema.QUAD}")
    for searched in (True, False):
        r = search.sweep(start, square, marks(spark, 12), marks(spark, 12), trials=3, searched=searched, turns=2).first()
        assert r.success and r.name.startswith("Best-" if searched else "Balanced") and r.optimized_error > 0 and r.squares_count == 1


def picture(h=160, w=200):
    a = np.full((h, w, 3), 30, np.uint8)
    a[10:150, 10:190] = 250
    a[40:110, 50:120] = 20
    return a


def images(spark, *arrays):
    return spark.createDataFrame([row_of(f"i{k}", a) for k, a in enumerate(arrays)], schema.IMAGES)


def test_detects_the_nested_square(spark):
    found = detect.squares(images(spark, picture()), 2000).collect()
    corners = [[(round(p.x), round(p.y)) for p in r.corners] for r in found]
    want = [(49.5, 39.5), (119.5, 39.5), (119.5, 109.5), (49.5, 109.5)]
    assert any(np.abs(np.array(c) - want).max() <= 1.5 for c in corners), corners


def test_blank_images_have_no_squares(spark):
    assert detect.squares(images(spark, np.full((60, 60, 3), 255, np.uint8), np.zeros((60, 60, 3), np.uint8))).count() == 0


def test_warps(spark):
    a = picture()
    h = lambda v: spark.range(1).select(F.lit("i0").alias("image_id"), homography(v).alias("h"))
    same = warp.warp(images(spark, a), h([1, 0, 0, 0, 1, 0, 0, 0, 1])).first()
    assert bytes(same.data) == a.tobytes()
    moved = warp.warp(images(spark, a), h([1, 0, 5, 0, 1, 3, 0, 0, 1]), 210, 170).first()
    out = np.frombuffer(moved.data, np.uint8).reshape(170, 210, 3)
    assert (out[3:163, 5:205] == a).all() and not out[:3].any()
    assert similarity(0, 2, 3, 1, 10, 20)[2:6:3] == pytest.approx([2, 3])
    turned = warp.rotate_and_translate(images(spark, a), 0, 0, 0, shape=(200, 160)).first()
    assert bytes(turned.data) == a.tobytes()


HOMOGRAPHIES = {
    "turned": [0.8, -0.6, 60, 0.6, 0.8, -30, 0, 0, 1],
    "tilted": [1.1, 0.3, -20, 0.1, 0.9, 5, 2e-3, 1e-3, 1],
    "horizon": [1, 0.2, 0, 0.1, 1, 0, -1.3e-2, 4e-3, 1],  # the denominator changes its sign inside the output
    "enlarged": [40, 0, -3000, 0, 40, -2000, 0, 0, 1],
    "shrunk": [0.05, 0, 3, 0, 0.05, 4, 0, 0, 1],
    "far": [1, 0, 1e7, 0, 1, 1e7, 0, 0, 1],
    "mirrored": [-1, 0, 190, 0, -1, 150, 0, 0, 1],
}


def test_warps_of_any_kind(spark):
    """Sides that are no multiple of a tile, places beyond every border, rows of the horizon: each pixel as in plain numpy."""
    a = np.random.default_rng(9).integers(0, 256, (133, 197, 3)).astype(np.uint8)
    a[40:90, 50:130] = 0
    rows = explode(images(spark, a)).drop("image_id")
    names = spark.createDataFrame([(n, i) for i, n in enumerate(HOMOGRAPHIES)], "image_id string, pos int")
    h = F.element_at(F.array(*(homography(v) for v in HOMOGRAPHIES.values())), F.col("pos") + 1)
    views = names.select("image_id", h.alias("h"), F.lit(140).alias("height"), (F.lit(200) + F.col("pos")).alias("width"))
    got = warp.warp_pixels(rows.crossJoin(names.select("image_id")), views, list("bgr")).toPandas()
    assert not got.duplicated(["image_id", "y", "x"]).any()
    for i, (name, h) in enumerate(HOMOGRAPHIES.items()):
        own, out = got[got.image_id == name], np.zeros((140, 200 + i, 3), int)
        assert len(own) == 140 * (200 + i), name
        out[own.y, own.x] = own[list("bgr")]
        want = warped(a, np.array(h, float).reshape(3, 3), 200 + i, 140).astype(int)
        off = np.abs(out - want).max(axis=2)
        assert (off > 1).mean() < 1e-3 and (off > 0).mean() < 0.02, (name, off.max(), (off > 0).mean())


def test_warps_of_awkward_views(spark):
    a = picture(30, 20)
    rows = explode(images(spark, a, np.zeros((30, 20, 3), np.uint8)))
    views = spark.createDataFrame([("i0", 5, 7), ("i1", 5, 7), ("gone", 5, 7)], "image_id string, height int, width int")
    flat = views.withColumn("h", homography([0, 0, 0, 0, 0, 0, 0, 0, 1]))
    black = warp.warp_pixels(rows, flat, list("bgr")).groupBy("image_id").agg(F.count("*").alias("n"), F.max("b").alias("b")).collect()
    assert {(r.image_id, r.n, r.b) for r in black} == {("i0", 35, 0), ("i1", 35, 0), ("gone", 35, 0)}
    assert warp.warp_pixels(rows, flat.withColumn("h", F.when(F.lit(False), F.col("h"))), list("bgr")).count() == 0
    same = flat.withColumn("h", homography([1, 0, 0, 0, 1, 0, 0, 0, 1]))
    holes = rows.where("image_id = 'i0' and (x + y) % 3 > 0")
    got = {(r.y, r.x): r.g for r in warp.warp_pixels(holes.union(holes), same, list("bgr")).where("image_id = 'i0'").collect()}
    assert all(v == (a[y, x, 1] if (x + y) % 3 else 0) for (y, x), v in got.items()) and len(got) == 35


def test_a_warp_deals_output_tiles_out(spark):
    """No exchange by image alone: tiles meet by (image, tile), pixels are made after a deal by output tile."""
    rows = explode(images(spark, picture()))
    views = spark.range(1).select(F.lit("i0").alias("image_id"), homography([1, 0, 0, 0, 1, 0, 0, 0, 1]).alias("h"), F.lit(64).alias("height"), F.lit(64).alias("width"))
    plan = warp.warp_pixels(rows, views, list("bgr"))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "oy" in plan.split("REPARTITION_BY_NUM")[0].rsplit("hashpartitioning", 1)[1]


def test_multiband_of_equal_images(spark):
    a = np.random.default_rng(2).integers(60, 200, (64, 64, 3)).astype(np.uint8)
    seam = np.zeros((64, 64), np.uint8)
    seam[:, :32] = 1
    out = multiband_blended(a, a, seam)
    assert np.abs(out.astype(int) - a).max() <= 1
    b = np.zeros_like(a)
    assert (multiband_blended(a, b, seam) == a).all()


def test_explode_pack_and_png(spark, tmp_path):
    a = picture(40, 30)
    rows = images(spark, a)
    back = pack(explode(rows), ["b", "g", "r"]).first()
    assert bytes(back.data) == a.tobytes()
    (tmp_path / "i.png").write_bytes(bytes(encode_png(rows).first().content))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    assert [bytes(r.data) for r in read_images(spark, str(tmp_path)).collect()] == [a.tobytes()]


def test_stream_projection(spark, tmp_path):
    from vistaquad.streaming.projection import project_stream

    p = marks(spark, 5)
    p.write.parquet(str(tmp_path / "in"))
    h = spark.range(1).select(F.lit("c").alias("camera_id"), homography([*TRUE, 1]).alias("h"))
    stream = project_stream(spark.readStream.schema(p.schema).parquet(str(tmp_path / "in")), h)
    stream.writeStream.format("memory").queryName("projected").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    assert all(abs(r.u - r.dst_x) < 1e-2 for r in spark.table("projected").collect())


def test_calibration_run(spark):
    from vistaquad.plans.calibrate import calibrate, evaluate, found_pairs, stitched, views
    from vistaquad.sources.points import roles

    p = marks(spark, 20).withColumn("camera_id", F.lit("i0"))
    p = p.union(p.withColumn("camera_id", F.lit("i1")))
    r = roles(spark, {c: {"optimization": list(range(9)), "anchor": list(range(9))} for c in ("i0", "i1")})
    shots = images(spark, picture(), picture())
    done = calibrate(shots, p, r, [("L-BFGS-B", "strict", 0.9)], 2000).cache()
    assert {x.n_squares for x in done.collect()} == {2}  # the bright field is nested in its frame, too
    assert evaluate(done, p, r).count() == 2
    seen = views(shots, done, 120, 100).cache()
    pairs = found_pairs(shots, done, 120, 100)
    assert [tuple(r) for r in pairs.collect()] == [("i0", "i1")]
    for method in ("first_wins", "blend", "feather", "multiband"):
        assert stitched(seen, pairs, method).count() > 0


def test_whole_experiment(spark, tmp_path):
    from vistaquad.plans.calibrate import multi_camera
    from vistaquad.sources.points import roles

    p = marks(spark, 20).withColumn("camera_id", F.lit("i0"))
    p = p.union(p.withColumn("camera_id", F.lit("i1")))
    r = roles(spark, {c: {"optimization": list(range(9)), "anchor": [3, 5, 3]} for c in ("i0", "i1")})
    path = str(tmp_path / "run")
    summary = multi_camera(images(spark, picture(), picture()), p, r, path, "both", "i0", "i1", [("L-BFGS-B", "strict", 0.9)], width=200, height=160, files=str(tmp_path / "files")).first()
    names = {str(f.relative_to(tmp_path / "files")) for f in (tmp_path / "files").rglob("*.*")}
    assert len(names) == 2 * 5 + 8 + 1 and {"cameras/i1/i1_optimized.png", "panorama_stitching/i0%2Bi1/stitched_multiband.png", "both/experiment_summary.txt"} <= names
    assert (summary.experiment, summary.total_cameras, summary.camera_names) == ("both", 2, ["i0", "i1"]) and len(summary.metrics) == 6
    assert 0 <= summary.metrics["i0_optimized_error"] < 5
    found = spark.read.parquet(f"{path}/panorama_stitching/images").collect()
    assert len(found) == 8 and len({x.name for x in found}) == 8 and {x.pair_id for x in found} == {"i0+i1"}
    done = spark.read.parquet(f"{path}/stitched").where("name = 'stitched_with_anchor_points'").first()
    pixels = np.frombuffer(done.data, np.uint8).reshape(done.height, done.width, 3)
    labels = {x.label: (x.x, x.y) for x in spark.read.parquet(f"{path}/labels").collect()}
    assert set(labels) == {f"{s}{i}" for s in "LR" for i in (1, 2, 3)} and labels["L1"] == labels["L3"]
    inside = [(x, y) for x, y in labels.values() if 0 <= x < done.width and 0 <= y < done.height]
    assert all(pixels[y, x].tolist() == [0, 255, 0] for x, y in inside)  # the second camera's discs lie on the first's
    assert [x.value for x in spark.read.text(f"{path}/cameras/results_text").where("camera_id = 'i1'").collect()][0] == "I1 RESULTS"
    assert {x.camera_id for x in spark.read.json(f"{path}/configurations/configs").collect()} == {"i0", "i1"}
