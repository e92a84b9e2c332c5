"""Search of refinement settings: a seeded sample of trials, all run side by side in the same rounds."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import from_params, improvement
from vistaquad.operators import points, report
from vistaquad.operators.population import TURNS, marks_of, optimised, params_of, wrong_stages
from vistaquad.operators.refine import as_stages
from vistaquad.sources.schema import STAGES
from vistaquad.sources.shared import settle

# What a level may be.
METHODS, MODES, WEIGHT_RANGE, LEVELS = ["Powell", "L-BFGS-B", "TNC"], ["none", "strict", "adaptive"], (0.05, 2.0), (1, 4)
BALANCED = [("Powell", "adaptive", 0.7), ("Powell", "strict", 0.4), ("Powell", "adaptive", 0.2)]


def _drawn(seed: int, *what: Column) -> Column:
    """A number in [0, 1) from the MD5 of the seed and what it is drawn for."""
    key = F.concat_ws(":", F.lit(str(seed)), *(w.cast("string") for w in what))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample(cameras: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """n trials for each camera of cameras (camera_id): levels, and method, bounds and log-uniform weight of each level.

    Every draw is a hash of seed, camera, trial and level, so trials are made where the cameras are, the same each time.
    """
    camera, trial = F.col("camera_id"), F.col("trial_id")
    rows = cameras.select("camera_id").withColumn("trial_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    low, high = LEVELS
    rows = rows.withColumn("levels", (F.floor(_drawn(seed, camera, trial, F.lit("levels")) * (high - low + 1)) + low).cast("int"))

    def level(i: Column) -> Column:
        pick = lambda items, name: F.get(F.array(*map(F.lit, items)), F.floor(_drawn(seed, camera, trial, i, F.lit(name)) * len(items)).cast("int"))
        weight = F.lit(WEIGHT_RANGE[0]) * F.pow(F.lit(WEIGHT_RANGE[1] / WEIGHT_RANGE[0]), _drawn(seed, camera, trial, i, F.lit("weight")))
        return F.struct(pick(METHODS, "method").alias("method"), pick(MODES, "bounds").alias("bounds"), weight.alias("weight"))

    return rows.withColumn("stages", F.transform(F.sequence(F.lit(1), F.col("levels")), level).cast(STAGES))


def balanced(cameras: DataFrame) -> DataFrame:
    """The one fixed configuration that stands in for a search."""
    return cameras.select("camera_id", F.lit(0).alias("trial_id"), F.lit(len(BALANCED)).alias("levels"), as_stages(BALANCED).alias("stages"))


def run(trials: DataFrame, initial: DataFrame, squares: DataFrame, anchors: DataFrame, validation: DataFrame, size: float = 114.0, compat: bool = True, turns: int = TURNS) -> DataFrame:
    """Each trial's errors on validation points before and after, its homography, or why it failed.

    compat fails trials of one level and cameras without squares, as the search it follows does. All trials of all cameras
    are refined in the same rounds (see population); errors are means over the validation points under each homography.
    """
    by = ["camera_id", "trial_id"]
    counts = squares.groupBy("camera_id").agg(F.count("*").cast("int").alias("squares_count"))
    held = validation.groupBy("camera_id").agg(F.count("*").alias("held"))
    rows = trials.select(*by, "levels", "stages").join(initial.select("camera_id", params_of(F.col("h")).alias("x")), "camera_id").join(counts, "camera_id", "left").join(held, "camera_id", "left")
    wrong = [wrong_stages(F.col("stages")), F.when(F.col("x").isNull(), F.lit("ValueError: no first homography")), F.when(F.col("held").isNull(), F.lit("ValueError: no validation points"))]
    if compat:
        wrong = [F.when(F.col("levels") == 1, F.lit("ValueError: a list of one level isn't a bounds mode")), F.when(F.col("squares_count").isNull(), F.lit("ValueError: no squares")), *wrong]
    rows = settle(rows.withColumn("error", F.coalesce(*wrong)).drop("held"), "trials")
    done = optimised(rows.where("error is null"), marks_of(squares, anchors), size, by, turns)
    done = settle(done.select(*by, from_params(F.col("x")).alias("homography")), "trials")
    start = rows.where("x is not null").select("camera_id", from_params(F.col("x")).alias("h")).distinct()
    initial_error = points.mean_error(points.reprojection(validation, start)).select("camera_id", F.col("mean_error").alias("initial_error"))
    optimized = points.mean_error(points.reprojection(validation, done.withColumnRenamed("homography", "h")), tuple(by)).select(*by, F.col("mean_error").alias("optimized_error"))
    found = rows.join(done, by, "left").join(optimized, by, "left").join(initial_error, "camera_id", "left")
    success = F.col("error").isNull()
    gain, percent = improvement(F.col("initial_error"), F.col("optimized_error"))
    return found.select(
        *by, "levels", "stages", success.alias("success"), "error", F.when(success, F.col("initial_error")).alias("initial_error"), F.when(success, F.col("optimized_error")).alias("optimized_error"),
        F.when(success, gain).alias("improvement"), F.when(success, percent).alias("improvement_percent"), F.when(success, F.col("squares_count")).alias("squares_count"), "homography",
    )


best = report.best


def best_configs(results: DataFrame, square_area: float = 2000) -> DataFrame:
    """The configuration of each camera's best trial: name, levels, and a list for each setting of a level."""
    listed = [F.col("stages")[n].alias(c) for n, c in (("method", "methods"), ("bounds", "bounds_modes"), ("weight", "weights"))]
    return report.best(results).select("camera_id", F.concat(F.lit("Best-"), F.col("trial_id").cast("string")).alias("name"), F.col("levels"), *listed, F.lit(float(square_area)).alias("square_area"))


def of_configs(configs: DataFrame) -> DataFrame:
    """Configurations (see best_configs) as trials, to be run once more; all have trial_id 0."""
    zipped = F.arrays_zip(F.col("methods").alias("method"), F.col("bounds_modes").alias("bounds"), F.col("weights").alias("weight"))
    return configs.select("camera_id", F.lit(0).alias("trial_id"), "levels", F.slice(zipped, F.lit(1), F.col("levels")).cast(STAGES).alias("stages"))


def sweep(initial: DataFrame, squares: DataFrame, anchors: DataFrame, validation: DataFrame, trials: int = 50, seed: int = 42, searched: bool = True, size: float = 114.0, turns: int = TURNS) -> DataFrame:
    """One row for each camera: its best configuration of a search, run once more, or else the balanced one, and its errors."""
    if searched:
        found = run(sample(initial, trials, seed), initial, squares, anchors, validation, size, turns=turns)
        configs = best_configs(found)
    else:
        listed = [F.array(*(F.lit(s[i]) for s in BALANCED)).alias(c) for i, c in enumerate(("methods", "bounds_modes", "weights"))]
        configs = initial.select("camera_id", F.lit("Balanced-Powell").alias("name"), F.lit(len(BALANCED)).alias("levels"), *listed, F.lit(2000.0).alias("square_area"))
    configs = settle(configs, "configs")
    return configs.drop("levels").join(run(of_configs(configs), initial, squares, anchors, validation, size, turns=turns).drop("stages", "trial_id"), "camera_id")
