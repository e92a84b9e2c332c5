"""Stand-ins: the driver's tables hold no images or calibration points, so both are derived from them by formula."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaquad.functions.geometry import homography

# Fixed values of the stand-ins: two homographies (row by row), and point roles with repeated indices.
H_FIRST = [1.2, 0.1, 5, 0.05, 90, -3, 0.001, 0.002, 1]
H_SECOND = [1.05, 0.02, 1, 0.01, 1.1, -0.5, 0.0005, 0.001, 1]
ROLES = {"optimization": [1, 5, 9, 9, 13, 40], "anchor": [2, 4, 4, 31], "reprojection": [2, 31]}
IMAGE_ROWS = 250


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_points(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """A point for each lineitem: camera l_suppkey, src (quantity, discount), dst (src moved by tax)."""
    lines = read(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("camera_id"), F.col("l_quantity").alias("src_x"), F.col("l_discount").alias("src_y"), (F.col("l_quantity") + F.col("l_tax")).alias("dst_x"), (F.col("l_discount") * 2).alias("dst_y"), *more)


def with_h(points: DataFrame, values: list) -> DataFrame:
    return points.withColumn("h", homography(values))


def part_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.lit("camera1").alias("camera_id"), F.col("p_partkey").alias("idx"), F.col("p_size").cast("double").alias("src_x"), F.col("p_retailprice").alias("src_y"), (F.col("p_size") * 2).cast("double").alias("dst_x"), F.col("p_retailprice").alias("dst_y"))


def part_roles(spark: SparkSession) -> DataFrame:
    rows = [("camera1", role, pos, idx) for role, ids in ROLES.items() for pos, idx in enumerate(ids)]
    return spark.createDataFrame(rows, "camera_id string, role string, pos int, idx long")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images of 250 x 64: a row for each embedding."""
    rows = read(spark, sf_dir, "embeddings").select((F.col("vec_id") / IMAGE_ROWS).cast("int").alias("image_id"), (F.col("vec_id") % IMAGE_ROWS).cast("int").alias("y"), F.posexplode("embedding").alias("x", "e"))
    v = F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.col("e").cast("double") + 0.5) * 255)))
    return rows.select("image_id", "y", "x", v.cast("int").alias("v"))


def pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gray picture of 48 x 64 for each supplier: a bright field in a dark frame, and a dark square on it."""
    k, x, y = F.col("s_suppkey"), F.col("x"), F.col("y")
    suppliers = read(spark, sf_dir, "supplier")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism, suppliers.count() // 500)  # a task sorts 1.5 million pixels or so
    rows = suppliers.select("s_suppkey", k.cast("string").alias("image_id")).repartition(parts, "image_id").sortWithinPartitions("image_id")  # few rows: their pixels stay where they are made
    grid = rows.select("s_suppkey", "image_id", F.explode(F.sequence(F.lit(0), F.lit(47))).alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(63))))
    field = x.between(4, 59) & y.between(4, 43)
    left, top, size = 10 + k % 20, 8 + k % 7, 18 + k % 5
    square = x.between(left, left + size) & y.between(top, top + size)
    return grid.select("image_id", "y", "x", F.when(field & ~square, 230).otherwise(30).alias("v"))


def quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight quads for each embedding: quad_id, camera_id, corners."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"), "embedding")
    at = lambda k, i: F.get("embedding", F.col("j") * 8 + 2 * k + i).cast("double") * 1000
    corners = F.array(*(F.struct(at(k, 0).alias("x"), at(k, 1).alias("y")) for k in range(4)))
    return rows.select((F.col("vec_id") * 8 + F.col("j")).alias("quad_id"), (F.col("vec_id") % 10).alias("camera_id"), corners.alias("corners"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial results for each part: five cameras; every seventh failed."""
    k = F.col("p_partkey")
    ok = k % 7 != 0
    initial = (F.col("p_size") + 1).cast("double")
    return read(spark, sf_dir, "part").select(F.concat(F.lit("camera"), (k % 5).cast("string")).alias("camera_id"), k.alias("trial_id"), ok.alias("success"), F.when(ok, initial).alias("initial_error"), F.when(ok, initial * (k % 11) / 10).alias("optimized_error"))
