"""Relational operators of points: roles, projection, errors."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import as_float, distance, project


def select_role(points: DataFrame, roles: DataFrame, role: str, by: tuple = ("camera_id",)) -> DataFrame:
    """The points of a role in its order (pos); an index listed twice gives two rows."""
    return roles.where(F.col("role") == role).join(points, [*by, "idx"]).select(*by, "role", "pos", "idx", *(c for c in points.columns if c not in (*by, "idx")))


def holdout(points: DataFrame, roles: DataFrame, role: str, by: tuple = ("camera_id",)) -> DataFrame:
    """The points that a role doesn't list."""
    return points.join(roles.where(F.col("role") == role).select(*by, "idx"), [*by, "idx"], "left_anti")


def project_points(points: DataFrame, homographies: DataFrame | None = None, by: tuple = ("camera_id",), mode: str = "np") -> DataFrame:
    """points with u and v under the homography h of their camera (joined by key, or already a column)."""
    rows = points.join(homographies, list(by)) if homographies is not None else points
    u, v = project(F.col("h"), F.col("src_x"), F.col("src_y"), mode)
    return rows.withColumns({"u": u, "v": v})


def reprojection(points: DataFrame, homographies: DataFrame | None = None, by: tuple = ("camera_id",), mode: str = "np") -> DataFrame:
    """project_points with error: the distance to dst, which is rounded to float."""
    rows = project_points(points, homographies, by, mode)
    return rows.withColumn("error", distance(F.col("u"), F.col("v"), as_float(F.col("dst_x")), as_float(F.col("dst_y"))))


def mean_error(errors: DataFrame, by: tuple = ("camera_id",)) -> DataFrame:
    """mean_error and n of each group; with several sides in a group it is weighted by their counts."""
    return errors.groupBy(*by).agg(F.avg("error").alias("mean_error"), F.count("error").alias("n"))


def pooled_error(left: DataFrame, right: DataFrame, by: tuple = ("pair_id",)) -> DataFrame:
    """Errors of both sides of stitched views together: mean of all, and of each side."""
    both = left.select(*by, F.lit("left").alias("side"), "error").unionAll(right.select(*by, F.lit("right").alias("side"), "error"))
    side = lambda name: F.avg(F.when(F.col("side") == name, F.col("error")))
    return both.groupBy(*by).agg(F.avg("error").alias("mean_error"), side("left").alias("left_error"), side("right").alias("right_error"), F.count("error").alias("n"))


def in_canvas(points: DataFrame, width: int, height: int) -> DataFrame:
    """Points whose truncated u, v lie on the canvas."""
    u, v = F.col("u").cast("long"), F.col("v").cast("long")
    finite = (F.abs("u") < 1e15) & (F.abs("v") < 1e15)
    return points.where(finite).where((u >= 0) & (u < width) & (v >= 0) & (v < height))
