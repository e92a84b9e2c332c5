"""Sinks, read back; configurations from JSON; maps and lists on awkward values."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaquad.functions import nested
from vistaquad.functions.geometry import ENTRIES
from vistaquad.operators import report
from vistaquad.sources import points, schema, sinks

H = {e: float(i) for i, e in enumerate(ENTRIES)}


@pytest.fixture(scope="module")
def records(spark):
    calibrations = spark.createDataFrame([("cam1", H, H), ("cam2", H, None)], f"camera_id string, h_initial {schema.HOMOGRAPHY}, h {schema.HOMOGRAPHY}")
    roles = points.roles(spark, {"cam1": {"optimization": [4, 0, 4], "anchor": [7]}})
    errors = spark.createDataFrame([("cam1", 2.5, 1.25)], "camera_id string, initial_error double, optimized_error double")
    return sinks.camera_records(calibrations, roles, errors, 56)


def packed(spark, rows, extra):
    data = [(*keys, 2, 3, 1, bytes(range(6))) for keys in rows]
    return spark.createDataFrame(data, f"{extra}, height int, width int, channels int, data binary")


def test_camera_sink(spark, records, tmp_path):
    images = packed(spark, [("cam1", "initial"), ("cam1", "optimized"), ("s3://x/cam2.png", "initial")], "image_id string, kind string")
    sinks.write_cameras(records, str(tmp_path), images)
    rows = {r.camera_id: r for r in spark.read.parquet(f"{tmp_path}/params").collect()}
    assert rows["cam1"].point_indices == {"optimization": [4, 0, 4], "anchor": [7]} and rows["cam2"].point_indices is None and rows["cam1"].square_size == 56
    rows = {r.camera_id: r for r in spark.read.parquet(f"{tmp_path}/results").collect()}
    assert (rows["cam1"].improvement, rows["cam1"].improvement_percent) == (1.25, 50.0) and rows["cam2"].initial_error is None
    rows = spark.read.parquet(f"{tmp_path}/homographies").collect()
    assert len(rows) == 4 and [r.h22 for r in rows if r.camera_id == "cam1"] == [8.0, 8.0]
    text = [r.value for r in spark.read.text(f"{tmp_path}/results_text").where("camera_id = 'cam1'").collect()]
    assert text == ["CAM1 RESULTS", "=" * 13, "Initial error: 2.5000 px", "Optimized error: 1.2500 px", "Improvement: 1.2500 px (50.00%)"]
    files = spark.read.parquet(f"{tmp_path}/images").collect()
    assert sorted((r.camera_id, r.kind) for r in files) == [("cam1", "initial"), ("cam1", "optimized"), ("s3://x/cam2.png", "initial")]
    assert all(bytes(r.content).startswith(b"\x89PNG") for r in files)
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_cameras(records, str(tmp_path))


def test_config_sink(spark, tmp_path):
    configs = spark.createDataFrame([("cam1", "best-3", ["Powell", "TNC"], 114.0), ("cam2", None, [], None)], "camera_id string, name string, methods array<string>, square_size double")
    sinks.write_configs(configs, str(tmp_path))
    rows = {r.camera_id: r for r in spark.read.json(f"{tmp_path}/configs").collect()}
    assert rows["cam1"].methods == ["Powell", "TNC"] and rows["cam2"].name is None
    text = [r.value for r in spark.read.text(f"{tmp_path}/configs_text").where("camera_id = 'cam1'").collect()]
    assert text[0] == "CAM1 BEST CONFIGURATION" and len(text[1]) == len(text[0]) + 2 and text[2:] == ["name: best-3", 'methods: ["Powell","TNC"]', "square_size: 114.0"]


def test_stitching_sink(spark, tmp_path):
    images = packed(spark, [("1", "seam"), ("1", "blended"), ("2/x", "seam")], "pair_id string, name string")
    facts = spark.createDataFrame([("1", 2, "seam")], "pair_id string, num_images int, method string")
    sinks.write_stitching(images, str(tmp_path), facts)
    rows = {r.pair_id: r for r in spark.read.parquet(f"{tmp_path}/summary").collect()}
    assert (rows["1"].num_images, rows["1"].method, rows["1"].generated) == ("2", "seam", ["blended", "seam"])
    assert (rows["2/x"].num_images, rows["2/x"].method) == ("N/A", "N/A")
    assert sorted((str(r.pair_id), r.name) for r in spark.read.parquet(f"{tmp_path}/images").collect()) == [("1", "blended"), ("1", "seam"), ("2/x", "seam")]
    text = [r.value for r in spark.read.text(f"{tmp_path}/summary_text").where("pair_id = '1'").collect()]
    assert text == ["STITCHING SUMMARY", "=" * 17, "Number of images: 2", "Method: seam", "Generated files:", "  - blended", "  - seam"]
    assert sinks.stitching_summary(images).select("method").distinct().collect()[0].method == "N/A"


def test_config_scan(spark, tmp_path):
    config = {"camera1": {"image_path": "a.jpg", "points_file": "img1", "point_indices": {"optimization_points": [0, 4, 4], "anchor_points": []}}, "camera2": {"src_points": [[1, 2], [3, 4]], "dst_points": [[5, 6]], "more": 1}}
    (tmp_path / "cameras.json").write_text(json.dumps(config, indent=1))
    (tmp_path / "broken.json").write_text("not json")
    found = points.read_config(spark, str(tmp_path)).cache()
    assert {r.camera_id: r.image_path for r in found.collect()} == {"camera1": "a.jpg", "camera2": None}
    assert [tuple(r) for r in points.config_roles(found).orderBy("role", "pos").collect()] == [("camera1", "optimization", 0, 0), ("camera1", "optimization", 1, 4), ("camera1", "optimization", 2, 4)]
    assert [tuple(r) for r in points.config_points(found).collect()] == [("camera2", 0, 1.0, 2.0, 5.0, 6.0)]


def test_npy_points(spark, tmp_path):
    for side, values in (("src", [[1, 2], [3, 4]]), ("dst", [[5, 6], [7, 8]])):
        np.save(tmp_path / f"img_1_{side}.npy", np.array(values, float))
    np.save(tmp_path / "alone_src.npy", np.zeros((2, 2)))
    rows = points.npy_points(spark, str(tmp_path)).orderBy("idx").collect()
    assert [tuple(r) for r in rows] == [("img_1", 0, 1.0, 2.0, 5.0, 6.0), ("img_1", 1, 3.0, 4.0, 7.0, 8.0)]


def test_nested(spark):
    rows = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 4}), (None, {"a": 1}), ({"a": 1}, None), ({}, {})], "l map<string,int>, r map<string,int>")
    got = [r.m for r in rows.select(nested.merged(F.col("l"), F.col("r")).alias("m")).collect()]
    assert got == [{"a": 1, "b": 3, "c": 4}, {"a": 1}, {"a": 1}, {}]
    assert [r.v for r in rows.select(nested.get_or(F.col("l"), "b", 9).alias("v")).collect()] == [2, 9, 9, 9]
    lists = spark.createDataFrame([(["x"], 3), (["x", "y", "z"], 2), ([], 2), (["x"], 0)], "i array<string>, n int")
    assert [r.v for r in lists.select(nested.levelled(F.col("i"), F.col("n")).alias("v")).collect()] == [["x"] * 3, ["x", "y"], [], []]


def test_summary_of_an_experiment(spark):
    rows = spark.createDataFrame([("e", "b", 0, 2.0, 1.0, 1.0), ("e", "a", 1, 3.0, 1.5, 1.5)], "experiment string, camera_id string, pos int, initial_error double, optimized_error double, improvement double")
    extra = spark.createDataFrame([("e", {"a_improvement": 9.0, "num_images": 2.0}), ("other", {"x": 1.0})], "experiment string, metrics map<string,double>")
    r = report.experiment_summary(rows, extra).first()
    assert (r.total_cameras, r.camera_names) == (2, ["b", "a"]) and r.metrics["a_improvement"] == 9 and r.metrics["b_initial_error"] == 2 and r.metrics["num_images"] == 2 and len(r.metrics) == 7
    assert len(report.experiment_summary(rows).first().metrics) == 6
