"""Files as sources and sinks: ranges, filters, what a failed task leaves, round trips."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.functions.geometry import ENTRIES
from vistaquad.operators import report
from vistaquad.sources import files, schema, sinks
from vistaquad.sources.images import read_images


@pytest.fixture
def folder(tmp_path):
    rng, sets = np.random.default_rng(1), {}
    for camera, n, kind in (("cam_a", 25, float), ("b", 3, np.int16), ("none", 0, np.float32)):
        sets[camera] = [(rng.uniform(-300, 300, (n, 2))).astype(kind) for _ in range(2)]
        for side, points in zip(("src", "dst"), sets[camera], strict=True):
            np.save(tmp_path / f"{camera}_{side}.npy", points)
    (tmp_path / "readme.txt").write_text("x")
    return tmp_path, sets


def test_points(spark, folder, monkeypatch):
    path, sets = folder
    rows = files.read_points(spark, str(path)).collect()
    got = {(r.camera_id, r.idx): (r.src_x, r.src_y, r.dst_x, r.dst_y) for r in rows}
    assert len(rows) == len(got) == 28
    for camera, (src, dst) in sets.items():
        for i in range(len(src)):
            assert got[camera, i] == (*src[i], *dst[i])
    assert files.read_points(spark, f"file://{path}").count() == 28


def test_ranges(folder, monkeypatch):
    """Files of more than ROWS points are read by several tasks."""
    path, sets = folder
    monkeypatch.setattr(files, "ROWS", 10)
    reader = files._PointReader(str(path))
    parts = reader.partitions()
    assert [(p.low, p.high) for p in parts if p.camera == "cam_a"] == [(0, 10), (10, 20), (20, 25)]
    read = [x for p in parts if p.camera == "cam_a" for b in reader.read(p) for x in b.column("dst_y").to_pylist()]
    assert read == list(sets["cam_a"][1][:, 1])


def test_filters_leave_files_unread(spark, folder):
    path, _ = folder
    os.remove(path / "b_dst.npy")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        assert files.read_points(spark, str(path)).where("camera_id = 'cam_a' and idx > 4").count() == 20
        assert files.read_points(spark, str(path)).where("camera_id in ('cam_a', 'none', 'absent')").count() == 25
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(Exception, match="destination points are missing"):
        files.read_points(spark, str(path)).count()


def test_wrong_arrays(spark, tmp_path):
    np.save(tmp_path / "a_src.npy", np.array([{"x": 1}]), allow_pickle=True)
    np.save(tmp_path / "a_dst.npy", np.zeros((1, 2)))
    with pytest.raises(Exception, match="n x 2"):
        files.read_points(spark, str(tmp_path)).count()
    np.save(tmp_path / "a_src.npy", np.zeros((2, 2)))
    with pytest.raises(Exception, match="2 source points, but 1"):
        files.read_points(spark, str(tmp_path)).count()


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).select(F.concat(F.lit("x/"), "id", F.lit(".txt")).alias("path"), F.col("id").cast("string").cast("binary").alias("content"))
    broken = rows.withColumn("path", F.when(F.col("path") == "x/33.txt", F.lit("../33.txt")).otherwise(F.col("path")))
    with pytest.raises(Exception, match="no path below"):
        files.write_files(broken, str(tmp_path / "out"))
    assert not [f for _, _, names in os.walk(tmp_path) for f in names]
    files.write_files(rows, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["x"] and len(os.listdir(tmp_path / "out/x")) == 40
    files.write_files(rows.limit(1).withColumn("path", F.lit("plain.gz")), str(tmp_path / "raw"))
    assert (tmp_path / "raw/plain.gz").read_bytes() == b"0"  # bytes as they are, whatever the name
    assert (tmp_path / "out/x/17.txt").read_bytes() == b"17"
    for again in (rows.limit(1), rows.withColumn("path", F.lit("new.txt"))):  # there already; written twice
        with pytest.raises(Exception, match="FileExistsError"):
            files.write_files(again, str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["x"] and (tmp_path / "out/x/0.txt").read_bytes() == b"0"
    files.write_files(rows.withColumn("content", F.lit(None).cast("binary")), str(tmp_path / "out"), "overwrite")
    assert (tmp_path / "out/x/17.txt").read_bytes() == b"" and len(os.listdir(tmp_path / "out/x")) == 40


H = {e: float(i) for i, e in enumerate(ENTRIES)}


def test_experiment(spark, tmp_path):
    """All files of two cameras, read back: matrices, pictures by Spark's own reader, texts."""
    calibrations = spark.createDataFrame([("cam1", H, H), ("a/b", H, None)], f"camera_id string, h_initial {schema.HOMOGRAPHY}, h {schema.HOMOGRAPHY}")
    errors = spark.createDataFrame([("cam1", 2.5, 1.25), ("a/b", 4.0, 4.0)], "camera_id string, initial_error double, optimized_error double")
    records = sinks.camera_records(calibrations, spark.createDataFrame([], schema.ROLES), errors, 56)
    pixels = bytes(range(2 * 3 * 3))
    views = spark.createDataFrame([("cam1", 2, 3, 3, pixels, "initial"), ("a/b", 2, 3, 3, pixels, "optimized")], f"{schema.IMAGES}, kind string")
    images = spark.createDataFrame([("p", "seam_mask", 2, 3, 3, pixels)], "pair_id string, name string, height int, width int, channels int, data binary")
    summary = report.experiment_summary(records.withColumns({"experiment": F.lit("run 1"), "pos": F.when(F.col("camera_id") == "cam1", 0).otherwise(1)})).withColumn("timestamp", F.lit("2024-05-06T07:08:09.000123"))
    sinks.write_experiment(records, views, images, summary, str(tmp_path))
    found = sorted(os.path.relpath(os.path.join(d, n), tmp_path) for d, _, names in os.walk(tmp_path) for n in names)
    assert found == sorted(["cameras/cam1/cam1_homography_initial.npy", "cameras/cam1/cam1_homography_optimized.npy", "cameras/cam1/cam1_initial.png", "cameras/cam1/cam1_results.txt", "cameras/a%2Fb/a%2Fb_homography_initial.npy", "cameras/a%2Fb/a%2Fb_optimized.png", "cameras/a%2Fb/a%2Fb_results.txt", "panorama_stitching/p/seam_mask.png", "run+1/experiment_summary.txt"])
    assert (np.load(tmp_path / "cameras/cam1/cam1_homography_initial.npy") == np.arange(9.0).reshape(3, 3)).all()
    for name in ("cameras/cam1/cam1_initial.png", "panorama_stitching/p/seam_mask.png"):
        r = read_images(spark, str(tmp_path / name)).first()
        assert (r.height, r.width, bytes(r.data)) == (2, 3, pixels)
    assert (tmp_path / "run+1/experiment_summary.txt").read_text() == """EXPERIMENT SUMMARY
==================
Experiment: run 1
Total cameras: 2
Camera names: ['cam1', 'a/b']
Date: 2024-05-06 07:08:09

REPROJECTION ERRORS:
cam1: 2.5000 -> 1.2500 px (improvement: 1.2500 px)
a/b: 4.0000 -> 4.0000 px (improvement: 0.0000 px)
"""
