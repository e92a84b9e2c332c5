"""What a run leaves behind, as tables and text under a folder of any store that Spark writes to, and as single files.

Nothing here gathers rows on the driver: each table is one write, partitioned by camera or pair. The lines of texts and the
names of files are fixed values.
"""

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import ENTRIES, improvement
from vistaquad.sources.files import write_files
from vistaquad.sources.images import encode_png


def camera_records(calibrations: DataFrame, roles: DataFrame, errors: DataFrame, size: float) -> DataFrame:
    """One row for each calibrated camera: indices of each role in order, square size, both homographies, errors, gain.

    calibrations: camera_id, h_initial, h; errors: camera_id, initial_error, optimized_error (null where none was held out).
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "idx"))), lambda p: p["idx"])
    by_role = roles.groupBy("camera_id", "role").agg(ordered.alias("idx")).groupBy("camera_id").agg(F.map_from_entries(F.collect_list(F.struct("role", "idx"))).alias("point_indices"))
    gain, percent = improvement(F.col("initial_error"), F.col("optimized_error"))
    rows = calibrations.select("camera_id", "h_initial", "h").join(by_role, "camera_id", "left").join(errors.select("camera_id", "initial_error", "optimized_error"), "camera_id", "left")
    return rows.withColumns({"square_size": F.lit(float(size)), "improvement": gain, "improvement_percent": percent})


def result_lines(records: DataFrame) -> DataFrame:
    """camera_id and value: a text of four lines, errors to four places and percent to two."""
    head = F.concat(F.upper("camera_id"), F.lit(" RESULTS"))
    return records.select(
        "camera_id",
        F.concat_ws(
            "\n",
            head,
            F.repeat(F.lit("="), F.length(head) + 1),
            F.format_string("Initial error: %.4f px", "initial_error"),
            F.format_string("Optimized error: %.4f px", "optimized_error"),
            F.format_string("Improvement: %.4f px (%.2f%%)", "improvement", "improvement_percent"),
        ).alias("value"),
    )


def write_cameras(records: DataFrame, path: str, images: DataFrame | None = None, mode: str = "error") -> None:
    """Tables params, results, homographies (kind initial or optimized) and images (PNG files), and the results as text.

    images: image_id (the camera's), kind and the packed columns of sources.schema.IMAGES.
    """

    def table(frame: DataFrame, name: str) -> None:
        frame.write.mode(mode).partitionBy("camera_id").parquet(f"{path}/{name}")

    table(records.select("camera_id", "point_indices", "square_size"), "params")
    table(records.select("camera_id", "initial_error", "optimized_error", "improvement", "improvement_percent"), "results")
    both = F.explode(F.array(*(F.struct(F.lit(kind).alias("kind"), F.struct(*(F.col(h)[e].alias(e) for e in ENTRIES)).alias("h")) for kind, h in (("initial", "h_initial"), ("optimized", "h")))))
    table(records.select("camera_id", both.alias("b")).select("camera_id", "b.kind", "b.h.*"), "homographies")
    result_lines(records).write.mode(mode).partitionBy("camera_id").text(f"{path}/results_text")
    if images is not None:
        named = images.withColumn("image_id", F.concat_ws("/", "image_id", "kind")).drop("kind")
        parts = F.split("image_id", "/")
        table(encode_png(named).select(F.concat_ws("/", F.slice(parts, F.lit(1), F.size(parts) - 1)).alias("camera_id"), F.get(parts, F.size(parts) - 1).alias("kind"), "content"), "images")


def write_configs(configs: DataFrame, path: str, mode: str = "error") -> None:
    """One JSON row for each camera, and the same as lines `key: value`."""
    configs.write.mode(mode).partitionBy("camera_id").json(f"{path}/configs")
    keys = [c for c in configs.columns if c != "camera_id"]
    head = F.concat(F.upper("camera_id"), F.lit(" BEST CONFIGURATION"))
    # A text of a value is that of its JSON, without the quotes of plain strings.
    shown = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c) if t == "string" else F.get_json_object(F.to_json(F.struct(c)), f"$.{c}"), F.lit("none"))) for c, t in configs.dtypes if c in keys]
    lines = configs.select("camera_id", F.concat_ws("\n", head, F.repeat(F.lit("="), F.length(head) + 2), *shown).alias("value"))
    lines.write.mode(mode).partitionBy("camera_id").text(f"{path}/configs_text")


def stitching_summary(images: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """For each pair: num_images and method (text; N/A where facts lack them) and the names of its images in order.

    images: pair_id, name; facts: pair_id, num_images, method.
    """
    names = images.groupBy("pair_id").agg(F.array_sort(F.collect_set("name")).alias("generated"))
    if facts is None:
        return names.select("pair_id", F.lit("N/A").alias("num_images"), F.lit("N/A").alias("method"), "generated")
    rows = names.join(facts.select("pair_id", "num_images", "method"), "pair_id", "left")
    return rows.select("pair_id", *(F.coalesce(F.col(c).cast("string"), F.lit("N/A")).alias(c) for c in ("num_images", "method")), "generated")


def write_stitching(images: DataFrame, path: str, facts: DataFrame | None = None, mode: str = "error") -> None:
    """Images of each pair as PNG files in a table, the summary as a table and as text.

    images: pair_id (a string), name and the packed columns of sources.schema.IMAGES but image_id. A seam mask of 0 and 1
    is stored as it comes: scale it before.
    """
    packed = images.withColumn("image_id", F.concat_ws("/", F.col("name"), F.col("pair_id").cast("string")))
    parts = F.split("image_id", "/", 2)
    files = encode_png(packed.drop("pair_id", "name")).select(F.get(parts, F.lit(1)).alias("pair_id"), F.get(parts, F.lit(0)).alias("name"), "content")
    files.write.mode(mode).partitionBy("pair_id").parquet(f"{path}/images")
    summary = stitching_summary(images.select("pair_id", "name"), facts)
    summary.write.mode(mode).parquet(f"{path}/summary")
    lines = F.concat_ws("\n", F.lit("STITCHING SUMMARY"), F.lit("=" * 17), F.concat(F.lit("Number of images: "), "num_images"), F.concat(F.lit("Method: "), "method"), F.lit("Generated files:"), F.transform("generated", lambda n: F.concat(F.lit("  - "), n)))
    summary.select(F.col("pair_id").cast("string").alias("pair_id"), lines.alias("value")).write.mode(mode).partitionBy("pair_id").text(f"{path}/summary_text")


def _npy(frames):
    """(path, numbers) of 3 x 3 matrices to (path, content), as .npy files."""
    for frame in frames:
        out = []
        for numbers in frame["numbers"]:
            file = io.BytesIO()
            np.save(file, np.asarray(numbers, float).reshape(3, 3))
            out.append(file.getvalue())
        yield pd.DataFrame({"path": frame["path"], "content": out})


def camera_files(records: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """(path, content) of each camera's files, in a folder of its name: {camera}_homography_initial.npy and _optimized.npy,
    {camera}_results.txt, {camera}_initial.png and _optimized.png. Names are URL-encoded; a null matrix gives no file.

    records: see camera_records; images: image_id (the camera's), kind (initial, optimized) and the packed columns.
    """
    name = F.url_encode(F.col("camera_id").cast("string"))
    place = lambda *end: F.concat(name, F.lit("/"), name, *(F.lit(e) if isinstance(e, str) else e for e in end)).alias("path")
    made = []
    for kind, h in (("initial", "h_initial"), ("optimized", "h")):
        rows = records.where(F.col(h).isNotNull()).select(place(f"_homography_{kind}.npy"), F.array(*(F.col(h)[e] for e in ENTRIES)).alias("numbers"))
        made.append(rows.mapInPandas(_npy, "path string, content binary"))
    made.append(result_lines(records).select(place("_results.txt"), F.concat("value", F.lit("\n")).cast("binary").alias("content")))
    if images is not None:
        named = images.withColumn("camera_id", F.col("image_id")).withColumn("image_id", place("_", F.col("kind"), ".png"))
        made.append(encode_png(named.drop("kind", "camera_id")).select(F.col("image_id").alias("path"), "content"))
    found = made[0]
    for rows in made[1:]:
        found = found.unionByName(rows)
    return found


def summary_text(summary: DataFrame) -> DataFrame:
    """experiment and value: the summary (see report.experiment_summary, with timestamp) as a text of lines."""
    metric = lambda c, m: F.try_element_at("metrics", F.concat(c, F.lit(f"_{m}")))
    line = lambda c: F.format_string("%s: %.4f -> %.4f px (improvement: %.4f px)", c, metric(c, "initial_error"), metric(c, "optimized_error"), metric(c, "improvement"))
    names = F.concat(F.lit("["), F.array_join(F.transform("camera_names", lambda c: F.concat(F.lit("'"), c, F.lit("'"))), ", "), F.lit("]"))
    when = F.date_format(F.to_timestamp("timestamp"), "yyyy-MM-dd HH:mm:ss")
    head = [F.lit("EXPERIMENT SUMMARY"), F.lit("=" * 18), F.concat(F.lit("Experiment: "), F.col("experiment").cast("string")), F.concat(F.lit("Total cameras: "), F.col("total_cameras").cast("string")), F.concat(F.lit("Camera names: "), names), F.concat(F.lit("Date: "), when)]
    lines = F.concat(F.array(*head, F.lit(""), F.lit("REPROJECTION ERRORS:")), F.transform("camera_names", line))
    return summary.select("experiment", F.array_join(lines, "\n").alias("value"))


def stitching_files(images: DataFrame, folder: str = "panorama_stitching") -> DataFrame:
    """(path, content) of each pair's images: {folder}/{pair}/{name}.png. images: see write_stitching."""
    path = F.concat_ws("/", F.lit(folder), F.url_encode(F.col("pair_id").cast("string")), F.concat(F.url_encode("name"), F.lit(".png")))
    return encode_png(images.withColumn("image_id", path).drop("pair_id", "name")).select(F.col("image_id").alias("path"), "content")


def write_experiment(records: DataFrame, views: DataFrame, images: DataFrame, summary: DataFrame, folder: str, mode: str = "append") -> None:
    """Every file of an experiment in one write that leaves all of them or none before its commit: cameras/, the stitched
    images, and experiment_summary.txt in the folder of the experiment."""
    cameras = camera_files(records, views).withColumn("path", F.concat(F.lit("cameras/"), "path"))
    text = summary_text(summary).select(F.concat(F.url_encode(F.col("experiment").cast("string")), F.lit("/experiment_summary.txt")).alias("path"), F.concat("value", F.lit("\n")).cast("binary").alias("content"))
    write_files(cameras.unionByName(stitching_files(images)).unionByName(text), folder, mode)
