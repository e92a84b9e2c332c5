"""Reports and annotations as ordinary tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import distance, project
from vistaquad.functions.nested import merged
from vistaquad.operators.points import in_canvas


def best(results: DataFrame, by: tuple = ("camera_id",)) -> DataFrame:
    """The successful result of least error, the first on a tie; cameras without one have no row. Nulls come last."""
    order = F.struct(F.isnull("optimized_error"), F.coalesce(F.col("optimized_error"), F.lit(0.0)), "trial_id")
    least = results.where("success").groupBy(*by).agg(F.min_by(F.struct(*results.columns), order).alias("_best"))
    return least.select("_best.*")


def summary(results: DataFrame, by: tuple = ("camera_id",)) -> DataFrame:
    """Trials, failures and mean errors of each camera."""
    return results.groupBy(*by).agg(F.count("*").alias("trials"), F.count_if(~F.col("success")).alias("failed"), F.avg("initial_error").alias("initial_error"), F.avg("optimized_error").alias("optimized_error"))


def long_form(frame: DataFrame, keys: list) -> DataFrame:
    """Numeric columns as rows (keys, metric, value); the form in which summaries are stored."""
    values = [c for c, t in frame.dtypes if c not in keys and t in ("int", "bigint", "double", "float")]
    return frame.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in values))).alias("m")).select(*keys, "m.metric", "m.value")


def wide_form(rows: DataFrame, keys: list, metrics: list) -> DataFrame:
    """Rows of long_form back to a column for each of the named metrics."""
    return rows.groupBy(*keys).pivot("metric", metrics).agg(F.first("value"))


def names(rows: DataFrame, by: tuple, name: str, position: str) -> DataFrame:
    """How many distinct names a group has, and the list of them by their first position."""
    first = rows.groupBy(*by, name).agg(F.min(position).alias("_at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_at", name))), lambda p: p[name])
    return first.groupBy(*by).agg(F.count("*").alias("total"), listed.alias("names"))


def metric_map(rows: DataFrame, by: tuple, name: str, metrics: list) -> DataFrame:
    """For each group a map {name}_{metric}: value over its rows, one row for each name."""
    entries = F.array(*(F.struct(F.concat_ws("_", name, F.lit(m)).alias("key"), F.col(m).cast("double").alias("value")) for m in metrics))
    return rows.groupBy(*by).agg(F.map_from_entries(F.flatten(F.collect_list(entries))).alias("metrics"))


def experiment_summary(records: DataFrame, extra: DataFrame | None = None, by: tuple = ("experiment",)) -> DataFrame:
    """One row for each experiment: total_cameras, camera_names in order of pos, and the metrics of all cameras as one map;
    extra (experiment, metrics) is merged into it and wins where both have a key."""
    listed = names(records, by, "camera_id", "pos").withColumnsRenamed({"total": "total_cameras", "names": "camera_names"})
    found = listed.join(metric_map(records, by, "camera_id", ["initial_error", "optimized_error", "improvement"]), list(by))
    if extra is None:
        return found
    rows = found.join(extra.select(*by, F.col("metrics").alias("_extra")), list(by), "left")
    return rows.withColumn("metrics", merged(F.col("metrics"), F.col("_extra"))).drop("_extra")


def stamps(ts: Column) -> tuple[Column, Column]:
    """A time as it stands in a summary's table (ISO, microseconds) and in its text."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def write(frame: DataFrame, path: str, by: tuple = ("camera_id",), mode: str = "error") -> None:
    """A table partitioned by camera."""
    frame.write.mode(mode).partitionBy(*by).parquet(path)


def text_report(frame: DataFrame) -> DataFrame:
    """A line for each camera: errors to four places, percent to two."""
    return frame.select(F.format_string("%s: initial %.4f, optimized %.4f, improvement %.2f%%", "camera_id", "initial_error", "optimized_error", F.when(F.col("initial_error") > 0, (F.col("initial_error") - F.col("optimized_error")) / F.nullif("initial_error", F.lit(0.0)) * 100).otherwise(0.0)).alias("value"))


def annotations(points: DataFrame, side: str, width: int, height: int, by: tuple = ("camera_id",)) -> DataFrame:
    """What to draw for points with h: truncated place, projected place, error and label, for those on the canvas."""
    u, v = project(F.col("h"), F.col("src_x"), F.col("src_y"), "cv")
    placed = points.withColumns({"u": u, "v": v})
    shown = in_canvas(placed, width, height)
    return shown.select(*by, "idx", F.col("dst_x").cast("long").alias("real_x"), F.col("dst_y").cast("long").alias("real_y"), F.col("u").cast("long").alias("proj_x"), F.col("v").cast("long").alias("proj_y"), distance(F.col("u"), F.col("v"), F.col("dst_x"), F.col("dst_y")).alias("error"), F.concat(F.lit(side), F.col("idx").cast("string")).alias("label"))


def draw_points(pixels: DataFrame, points: DataFrame, channels: list, color: list, radius: int = 6, by: tuple = ("image_id",)) -> DataFrame:
    """Filled circles at truncated u, v: the pixels of each circle are generated and joined, not compared with all."""
    offsets = [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]
    dots = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets)))
    hit = points.select(*by, F.col("u").cast("int").alias("u"), F.col("v").cast("int").alias("v"), dots.alias("o")).select(*by, (F.col("v") + F.col("o.i")).alias("y"), (F.col("u") + F.col("o.j")).alias("x")).distinct().withColumn("_hit", F.lit(True))
    drawn = pixels.join(hit, [*by, "y", "x"], "left")
    return drawn.withColumns({c: F.when(F.col("_hit"), F.lit(value)).otherwise(F.col(c)) for c, value in zip(channels, color, strict=True)}).drop("_hit")
