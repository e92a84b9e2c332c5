"""Masks as runs: rows (keys, y, start, end) of consecutive pixels of an image row, end not included.

A mask of large areas has a row for each of its stretches instead of one for each pixel. Runs of one mask don't overlap or
touch, so a mask has one form only. Masks are combined by a sweep over the ends of their runs, image row by image row: one
exchange by (keys, y), whatever the masks; areas, boxes and spans are sums over runs.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def runs_of(pixels: DataFrame, mask: Column, by: tuple = ("image_id",)) -> DataFrame:
    """The mask's runs: by, y, start, end. A null mask is false; a pixel that occurs twice counts once."""
    row = [*by, "y"]
    lit = pixels.where(mask).select(*row, "x")
    order = Window.partitionBy(*row).orderBy("x")
    placed = lit.withColumn("_run", F.col("x") - F.dense_rank().over(order))  # the same along a run
    return placed.groupBy(*row, "_run").agg(F.min("x").alias("start"), (F.max("x") + 1).alias("end")).drop("_run")


def pixels_of(runs: DataFrame, by: tuple = ("image_id",)) -> DataFrame:
    """by, y, x of every pixel of the runs."""
    return runs.where("start < end").select(*by, "y", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("x"))


def combined(masks: list, keep, by: tuple = ("image_id",)) -> DataFrame:
    """Runs of the places for which keep holds: a function of one boolean column for each mask to a boolean column, false
    where none is set. Runs that overlap or touch, in one mask or after combining, become one; empty ones count nothing."""
    row, sides = [*by, "y"], [f"_s{i}" for i in range(len(masks))]
    ends = None
    for i, runs in enumerate(masks):
        step = lambda of, by_one: F.struct(F.col(of).alias("x"), *(F.lit(by_one if k == i else 0).alias(s) for k, s in enumerate(sides)))  # noqa: B023, E731
        own = runs.where("start < end").select(*row, F.explode(F.array(step("start", 1), step("end", -1))).alias("e")).select(*row, "e.*")
        ends = own if ends is None else ends.unionAll(own)
    steps = ends.groupBy(*row, "x").agg(*(F.sum(s).alias(s) for s in sides))  # the ends that fall on one place
    order = Window.partitionBy(*row).orderBy("x")
    swept = steps.withColumns({s: F.sum(s).over(order.rowsBetween(Window.unboundedPreceding, 0)) > 0 for s in sides}).withColumn("_kept", keep(*(F.col(s) for s in sides)))
    turned = swept.withColumn("_was", F.coalesce(F.lag("_kept").over(order), F.lit(False))).where("_kept <> _was")  # where the result begins or ends
    paired = turned.withColumn("end", F.lead("x").over(order))
    return paired.where("_kept").select(*row, F.col("x").alias("start"), "end")


def union(one: DataFrame, other: DataFrame, by: tuple = ("image_id",)) -> DataFrame:
    return combined([one, other], lambda a, b: a | b, by)


def intersection(one: DataFrame, other: DataFrame, by: tuple = ("image_id",)) -> DataFrame:
    return combined([one, other], lambda a, b: a & b, by)


def difference(one: DataFrame, other: DataFrame, by: tuple = ("image_id",)) -> DataFrame:
    return combined([one, other], lambda a, b: a & ~b, by)


def boxes(runs: DataFrame, by: tuple = ("image_id",)) -> DataFrame:
    """Bounding box, centroid and number of the pixels of each mask, from its runs alone (see raster.boxes)."""
    n = F.col("end") - F.col("start")
    total = F.sum(n)
    return runs.groupBy(*by).agg(
        F.min("y").alias("y_min"), F.max("y").alias("y_max"), F.min("start").alias("x_min"), (F.max("end") - 1).alias("x_max"),
        (F.sum(n * (F.col("start") + F.col("end") - 1)) / (2 * total)).alias("x_mean"), (F.sum(n * F.col("y")) / total).alias("y_mean"), total.alias("n"),
    )


def spans(runs: DataFrame, by: tuple = ("image_id",)) -> DataFrame:
    """by, y, x_start, x_end: first and last column of the mask in each image row."""
    return runs.groupBy(*by, "y").agg(F.min("start").alias("x_start"), (F.max("end") - 1).alias("x_end"))


def seam_runs(mask1: DataFrame, mask2: DataFrame, costs: DataFrame, rows: DataFrame, by: tuple = ("pair_id",)) -> DataFrame:
    """The seam mask (see stitch.seam_mask) as runs: where the first image is taken.

    mask1 and mask2: runs of what is lit in either image; costs: by, y, x and blur, the blurred difference of each pixel, nulls last;
    rows: by, y, start and end, the extent of each image row. Masks, overlap, spans and the boundary of pairs without any
    overlap come from runs; only the least column of a span is looked for among pixels.
    """
    keys = list(by)
    shared = intersection(mask1, mask2, by)
    span = spans(shared, by).where("x_end - x_start > 5")
    inside = costs.join(span, [*keys, "y"]).where("x between x_start and x_end")
    least = inside.groupBy(*keys, "y").agg(F.first("x_start").alias("start"), F.min(F.struct(F.col("blur").isNull(), "blur", "x"))["x"].alias("end"))
    cut = union(difference(mask1, mask2, by), least, by)
    apart = rows.select(*keys).distinct().join(shared.select(*keys).distinct(), keys, "left_anti")
    middles = [boxes(m, by).select(*keys, F.col("x_mean").alias(f"m{i}")) for i, m in enumerate((mask1, mask2))]
    middle = apart.join(middles[0], keys, "left").join(middles[1], keys, "left").withColumn("at", F.floor((F.col("m0") + F.col("m1")) / 2))
    left = rows.join(middle.where("at is not null"), keys).select(*keys, "y", "start", F.least("end", "at").alias("end")).where("start < end")
    alone = mask1.join(middle.where("at is null").select(*keys), keys, "left_semi")
    return cut.join(apart, keys, "left_anti").unionByName(left).unionByName(alone.select(cut.columns))
