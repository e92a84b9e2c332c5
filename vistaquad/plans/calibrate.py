"""Whole runs: calibration of each camera, views from above, and their stitches, each a table asked for by itself."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import improvement
from vistaquad.operators import detect, estimate, footprints, points, pyramid, raster, refine, report, stitch, warp
from vistaquad.sources import sinks
from vistaquad.sources.images import explode, pack


def calibrate(images: DataFrame, point_table: DataFrame, roles: DataFrame, steps: list | None = None, min_area: float = 4000, size: float = 100.0) -> DataFrame:
    """camera_id, h_initial, h, objective, error, n_squares; image_id of images is the camera's name.

    Points of role "optimization" give the first homography, those of role "anchor" hold the refinement; without
    anchors the optimization points do. Detection runs once for each image; no view is warped here.
    """
    squares = detect.squares(images, min_area).withColumnRenamed("image_id", "camera_id")
    chosen = points.select_role(point_table, roles, "optimization")
    initial = estimate.ransac(chosen)
    anchors = points.select_role(point_table, roles, "anchor")
    alone = chosen.join(anchors.select("camera_id").distinct(), "camera_id", "left_anti")
    done = refine.refine(initial, squares, anchors.unionByName(alone), steps or refine.stages(), size)
    counts = squares.groupBy("camera_id").agg(F.count("*").alias("n_squares"))
    return done.join(initial.withColumnRenamed("h", "h_initial"), "camera_id").join(counts, "camera_id", "left").fillna(0, ["n_squares"]).select("camera_id", "h_initial", "h", "objective", "error", "n_squares")


def evaluate(calibrations: DataFrame, point_table: DataFrame, roles: DataFrame) -> DataFrame:
    """Mean error of the points held out from optimisation, before and after, with what was gained."""
    held = points.holdout(point_table, roles, "optimization")
    by = [points.mean_error(points.reprojection(held, calibrations.select("camera_id", F.col(h).alias("h")))).select("camera_id", F.col("mean_error").alias(n)) for h, n in (("h_initial", "initial_error"), ("h", "optimized_error"))]
    gain, percent = improvement(F.col("initial_error"), F.col("optimized_error"))
    return by[0].join(by[1], "camera_id").withColumns({"improvement": gain, "improvement_percent": percent})


def views(images: DataFrame, calibrations: DataFrame, width: int = 1600, height: int = 1200) -> DataFrame:
    """Every camera's image seen from above."""
    return warp.warp(images, calibrations.where("h is not null").select(F.col("camera_id").alias("image_id"), "h"), width, height)


CHANNELS = list("bgr")
ANCHOR_RADIUS, ANCHOR_COLORS = 8, ([255, 0, 0], [0, 255, 0])  # blue for the first camera, green for the second


def named_pair(spark, first: str, second: str) -> DataFrame:
    """The one pair of two cameras that are known by name."""
    return spark.createDataFrame([(first, second)], "first string, second string")


def found_pairs(images: DataFrame, calibrations: DataFrame, width: int, height: int) -> DataFrame:
    """first and second of all cameras whose views overlap on the canvas."""
    return footprints.overlapping(footprints.footprints(images, calibrations), width, height)


def paired(seen: DataFrame, pairs: DataFrame, how: str = "inner") -> DataFrame:
    """The views of every pair of pairs (first, second), pixel by pixel (see raster.pairs), named first+second."""
    pixels = explode(seen)
    named = pairs.select(F.concat("first", F.lit("+"), "second").alias("pair_id"), "first", "second")
    side = lambda which: pixels.join(named.select("pair_id", F.col(which).alias("image_id")), "image_id").select("pair_id", "y", "x", *CHANNELS)
    return raster.pairs(side("first"), side("second"), CHANNELS, how=how)


def stitched(seen: DataFrame, pairs: DataFrame, method: str) -> DataFrame:
    """Pixels (pair_id, y, x, b, g, r) of the views of every pair: first_wins, blend, feather, multiband or seam (white where
    the first is taken)."""
    rows = paired(seen, pairs, "full" if method == "first_wins" else "inner")
    if method == "seam":
        mask = stitch.seam_mask(rows, CHANNELS)
        return mask.select("pair_id", "y", "x", *((F.col("seam") * 255).alias(c) for c in CHANNELS))
    return {"first_wins": stitch.first_wins, "blend": stitch.blend, "feather": stitch.feather, "multiband": pyramid.multiband}[method](rows, CHANNELS)


def mosaic(seen: DataFrame, order: DataFrame) -> DataFrame:
    """Pixels (y, x, b, g, r) of all views in one picture; order: image_id, pos (the least is uppermost)."""
    return footprints.mosaic(explode(seen).join(order.select("image_id", "pos"), "image_id"), CHANNELS)


def anchor_overlay(pixels: DataFrame, calibrations: DataFrame, anchors: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pixels with a disc at each projected anchor of either camera of a pair, and the labels (L1, L2, .. and R1, R2, ..) with
    their places."""
    placed = points.project_points(anchors, calibrations.select("camera_id", "h"), mode="cv").where("u is not null and v is not null")
    labels = []
    for which, side, color in (("first", "L", ANCHOR_COLORS[0]), ("second", "R", ANCHOR_COLORS[1])):
        named = pairs.select(F.concat("first", F.lit("+"), "second").alias("pair_id"), F.col(which).alias("camera_id"))
        own = placed.join(named, "camera_id").select("pair_id", "u", "v", F.concat(F.lit(side), (F.col("pos") + 1).cast("string")).alias("label"))
        pixels = report.draw_points(pixels, own, CHANNELS, color, ANCHOR_RADIUS, by=("pair_id",))
        labels.append(own.select("pair_id", "label", F.col("u").cast("long").alias("x"), F.col("v").cast("long").alias("y")))
    return pixels, labels[0].union(labels[1])


def multi_camera(images: DataFrame, point_table: DataFrame, roles: DataFrame, path: str, experiment: str, first: str | None = None, second: str | None = None, steps: list | None = None, min_area: float = 2000, size: float = 56.0, width: int = 1600, height: int = 1200, files: str | None = None) -> DataFrame:
    """A whole experiment: every camera calibrated and judged, the views of every pair stitched in each way, all of it
    written under path (cameras, configurations, panorama_stitching, labels, summary). Returns the summary. files: a folder
    that gets images, matrices and texts as single files, too (see sinks.write_experiment).

    first and second name the one pair to stitch; without them all pairs are stitched whose views overlap on the canvas, and
    a mosaic of all cameras, in the order of their names, is written.

    What each step writes is read by the next, so nothing is worked out twice and a lost executor repeats one step.
    """
    spark = images.sparkSession

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{path}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{path}/{name}")

    levels = steps or refine.stages()
    done = kept(calibrate(images, point_table, roles, levels, min_area, size), "calibrations")
    records = kept(sinks.camera_records(done, roles, evaluate(done, point_table, roles), size), "records")
    seen = {kind: kept(views(images, done.select("camera_id", F.col(h).alias("h")), width, height), f"views_{kind}") for kind, h in (("initial", "h_initial"), ("optimized", "h"))}
    sinks.write_cameras(records, f"{path}/cameras", seen["initial"].withColumn("kind", F.lit("initial")).union(seen["optimized"].withColumn("kind", F.lit("optimized"))))
    listed = F.array(*(F.struct(F.lit(m).alias("method"), F.lit(b).alias("bounds"), F.lit(float(w)).alias("weight")) for m, b, w in levels))
    sinks.write_configs(done.select("camera_id", F.lit(f"Levels-{len(levels)}").alias("name"), F.lit(len(levels)).alias("levels"), listed.alias("stages")), f"{path}/configurations")

    pairs = kept(found_pairs(images, done, width, height) if first is None else named_pair(spark, first, second), "pairs")
    shown = {f"{name}_{kind}": stitched(seen[kind], pairs, method) for name, method in (("stitched", "first_wins"), ("blended", "blend")) for kind in seen}
    shown |= {name: stitched(seen["optimized"], pairs, method) for name, method in (("seam_mask", "seam"), ("stitched_optimal_seam", "feather"), ("stitched_multiband", "multiband"))}
    marked, labels = anchor_overlay(shown["stitched_optimized"], done, points.select_role(point_table, roles, "anchor"), pairs)
    shown["stitched_with_anchor_points"] = marked
    labels.write.parquet(f"{path}/labels")
    packed = None
    for name, pixels in shown.items():
        one = pack(pixels.select(F.col("pair_id").alias("image_id"), "y", "x", *CHANNELS), CHANNELS).withColumnRenamed("image_id", "pair_id").withColumn("name", F.lit(name))
        packed = one if packed is None else packed.unionByName(one)
    facts = pairs.select(F.concat("first", F.lit("+"), "second").alias("pair_id"), F.lit(2).alias("num_images"), F.lit("advanced_stitching").alias("method"))
    packed = kept(packed, "stitched")
    sinks.write_stitching(packed, f"{path}/panorama_stitching", facts)
    iso, _ = report.stamps(F.current_timestamp())
    if first is None:
        order = done.where("h is not null").select(F.col("camera_id").alias("image_id"), F.col("camera_id").alias("pos"))
        whole = mosaic(seen["optimized"], order)
        packed = packed.unionByName(kept(pack(whole.withColumn("image_id", F.lit("all")), CHANNELS).withColumnRenamed("image_id", "pair_id").withColumn("name", F.lit("mosaic")), "mosaic"))
    order = F.struct(F.when(F.col("camera_id") == F.lit(first), 0).when(F.col("camera_id") == F.lit(second), 1).otherwise(2), "camera_id")
    summary = kept(report.experiment_summary(records.withColumns({"experiment": F.lit(experiment), "pos": order})).withColumn("timestamp", iso), "summary")
    if files is not None:
        both = seen["initial"].withColumn("kind", F.lit("initial")).union(seen["optimized"].withColumn("kind", F.lit("optimized")))
        sinks.write_experiment(records, both, packed, summary, files)
    return summary
