"""Refinement of homographies under bounds, level by level (see population).

Each round lowers sum of square metrics + weight * sum of anchor distances. Methods: Powell (throws along a set of
directions); BFGS, L-BFGS-B and TNC (damped Newton steps from differences, all three by one rule).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import from_params
from vistaquad.operators.population import TURNS, marks_of, optimised, params_of, wrong_stages
from vistaquad.sources.schema import STAGES

# Defaults of the levels.
WEIGHTS, MODES, METHODS = [0.9, 0.5, 0.4], ["adaptive", "strict", "none"], ["Powell"] * 3


def stages(levels: int = 3, weights=None, modes=None, methods=None) -> list:
    """(method, bounds, weight) of each level: one name stands for all; short lists go on with their last item."""
    if levels < 1:
        raise ValueError("at least one level is needed")
    full = []
    for given, default in ((methods, METHODS), (modes, MODES), (weights, WEIGHTS)):
        items = list(default) if given is None else [given] if isinstance(given, (str, float, int)) else list(given)
        full.append((items + items[-1:] * levels)[:levels])
    return list(zip(*full, strict=True))


def as_stages(steps: list):
    """Levels as a column."""
    return F.array(*(F.struct(F.lit(m).alias("method"), F.lit(b).alias("bounds"), F.lit(float(w)).alias("weight")) for m, b, w in steps)).cast(STAGES)


def refine(initial: DataFrame, squares: DataFrame, anchors: DataFrame, steps: list, size: float = 100.0, turns: int = TURNS, compat: bool = True) -> DataFrame:
    """camera_id, h, objective, error: the refined homography of each camera of initial (camera_id, h).

    squares: camera_id, corners; anchors: camera_id, src_x.. dst_y. A camera without either keeps its h, moved into its
    bounds; a level that isn't known, or a camera without a first homography, gives a message in error and a null h.
    """
    runs = initial.select("camera_id", params_of(F.col("h")).alias("x"), as_stages(steps).alias("stages"))
    runs = runs.withColumn("error", F.coalesce(wrong_stages(F.col("stages")), F.when(F.col("x").isNull(), F.lit("ValueError: no first homography"))))
    done = optimised(runs.where("error is null"), marks_of(squares, anchors), size, ["camera_id"], turns, compat)
    found = runs.select("camera_id", "error").join(done, "camera_id", "left")
    return found.select("camera_id", F.when(F.col("x").isNotNull(), from_params(F.col("x"))).alias("h"), F.col("value").alias("objective"), "error")
