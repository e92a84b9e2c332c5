"""Pixel tables that are joined and blurred without an exchange: stored in bands of image rows, bucketed by (image, band).

A band holds BAND rows of an image and, as its halo, the HALO rows before and after them, so windows along either axis stay
inside of it. Two tables stored with as many buckets join on (image, band, y, x) bucket by bucket, and windows by (image,
band, y) or (image, band, x) read the same buckets; a hot image is spread over its bands. Operators take such tables with
("pair_id", "band") as their keys; owned() leaves the rows that a band answers for.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaquad.sources.shared import shared_dir

BAND, HALO = 64, 2


def banded(pixels: DataFrame) -> DataFrame:
    """pixels with band: each row in its own band, and in a neighbour's whose halo it belongs to."""
    own, at = F.floor(F.col("y") / BAND).cast("int"), F.pmod(F.col("y"), F.lit(BAND))
    near = F.when((at < HALO) & (own > 0), F.array(own, own - 1)).when(at >= BAND - HALO, F.array(own, own + 1)).otherwise(F.array(own))
    return pixels.withColumn("band", F.explode(near))


def is_owned() -> Column:
    return F.floor(F.col("y") / BAND) == F.col("band")


def owned(rows: DataFrame) -> DataFrame:
    """Rows of the bands' own, without band."""
    return rows.where(is_owned()).drop("band")


def _reader(spark: SparkSession) -> SparkSession:
    """A session beside spark, in which joins may rest on buckets by some of their keys; spark plans its own as before."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.autoBroadcastJoinThreshold"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own


def stored(pixels: DataFrame, name: str, buckets: int, by: tuple = ("pair_id",)) -> DataFrame:
    """pixels (by, y, x and more) written to the shared folder in bands, bucketed by (by, band); the table to read.

    Null keys are kept; a pixel that occurs twice is stored twice. The catalogue has no entry for it afterwards. What is
    made of the table is planned in a session of its own, in which buckets by (by, band) serve joins that have more keys.
    """
    spark = pixels.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    keys = [*by, "band"]
    placed = banded(pixels).repartition(buckets, *keys)  # one file a bucket
    placed.write.bucketBy(buckets, *keys).sortBy(*keys, "y", "x").option("path", f"{shared_dir(spark)}/vistaquad/{table}").saveAsTable(table, format="parquet")
    found = _reader(spark).table(table)
    spark.sql(f"drop table {table}")  # the files stay
    return found
