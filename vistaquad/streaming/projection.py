"""Projection of a stream of points: an extension, since the projection keeps no state."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import project


def project_stream(points: DataFrame, homographies: DataFrame, mode: str = "np") -> DataFrame:
    """A streaming DataFrame of points (camera_id, src_x, src_y) joined with static homographies (camera_id, h)."""
    u, v = project(F.col("h"), F.col("src_x"), F.col("src_y"), mode)
    return points.join(homographies, "camera_id").withColumns({"u": u, "v": v}).drop("h")
