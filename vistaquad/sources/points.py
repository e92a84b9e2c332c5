"""Point sets and roles from configurations and files."""

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaquad.sources import schema


def inline_points(spark: SparkSession, cameras: dict) -> DataFrame:
    """Points of configurations that hold src_points and dst_points: {camera: {"src_points": .., "dst_points": ..}}."""
    rows = []
    for camera, config in cameras.items():
        if "src_points" not in config or "dst_points" not in config:
            raise ValueError(f"{camera}: points_file or both of src_points and dst_points are needed")
        rows += [(camera, i, float(s[0]), float(s[1]), float(d[0]), float(d[1])) for i, (s, d) in enumerate(zip(config["src_points"], config["dst_points"], strict=True))]
    return spark.createDataFrame(rows, schema.POINTS)


CONFIG = "map<string,struct<image_path:string,points_file:string,src_points:array<array<double>>,dst_points:array<array<double>>,point_indices:map<string,array<int>>>>"


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """A row for each camera of JSON files {camera: {image_path, points_file, src_points, dst_points, point_indices}}.

    One file is one document; keys that are not named here are ignored, and a file that is no such JSON gives no row.
    """
    found = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", CONFIG)).alias("camera_id", "c"))
    return found.select("camera_id", "c.*")


def config_points(configs: DataFrame) -> DataFrame:
    """Points that configurations hold themselves: src_points and dst_points side by side, as far as the shorter one goes."""
    pairs = F.arrays_zip(F.slice("src_points", F.lit(1), F.size("dst_points")), F.slice("dst_points", F.lit(1), F.size("src_points")))
    rows = configs.where("src_points is not null and dst_points is not null").select("camera_id", F.posexplode(pairs).alias("idx", "p"))
    at = lambda side, i: F.get(F.col("p")[side], F.lit(i))
    return rows.select("camera_id", "idx", at("0", 0).alias("src_x"), at("0", 1).alias("src_y"), at("1", 0).alias("dst_x"), at("1", 1).alias("dst_y"))


def config_roles(configs: DataFrame) -> DataFrame:
    """point_indices as rows in order; a role loses its ending _points."""
    rows = configs.select("camera_id", F.explode("point_indices").alias("role", "ids"))
    return rows.select("camera_id", F.regexp_replace("role", "_points$", "").alias("role"), F.posexplode("ids").alias("pos", "idx"))


def _arrays(frames):
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            name = path.rsplit("/", 1)[-1].removesuffix(".npy")
            camera, _, side = name.rpartition("_")
            for i, (x, y) in enumerate(np.load(io.BytesIO(content), allow_pickle=False).reshape(-1, 2)):
                rows.append((camera, side, i, float(x), float(y)))
        yield pd.DataFrame(rows, columns=["camera_id", "side", "idx", "x", "y"])


def npy_points(spark: SparkSession, folder: str) -> DataFrame:
    """Points of {camera}_src.npy and {camera}_dst.npy in a folder on any store that Spark reads; pickles are refused.

    A camera with only one of the two files has no rows that match and is left out.
    """
    sides = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder).select("path", "content").mapInPandas(_arrays, "camera_id string, side string, idx int, x double, y double")
    one = lambda side: sides.where(F.col("side") == side).select("camera_id", "idx", F.col("x").alias(f"{side}_x"), F.col("y").alias(f"{side}_y"))
    return one("src").join(one("dst"), ["camera_id", "idx"])


def roles(spark: SparkSession, lists: dict) -> DataFrame:
    """{camera: {role: [idx, ..]}} as rows in order; an index may occur more than once."""
    rows = [(camera, role, pos, idx) for camera, by in lists.items() for role, ids in by.items() for pos, idx in enumerate(ids)]
    return spark.createDataFrame(rows, schema.ROLES)
