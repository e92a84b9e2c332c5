"""Runs of small cameras take all their rounds in one group, and end where a job for each round ends, bit by bit."""

import numpy as np

from vistaquad.operators import population
from vistaquad.operators.refine import as_stages


def test_rounds_in_one_group_equal_jobs(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    empty, number = [], lambda mean, spread, n: rng.normal(mean, spread, n).astype(np.float32).astype(float).tolist()
    rows = [(c, *(kinds), 2 * c + i) for c in range(3) for i, kinds in enumerate(((number(0, 90, 48), empty), (empty, number(5, 3, 32))))]
    blocks = spark.createDataFrame(rows, "camera_id long, squares array<double>, anchors array<double>, block long")  # two of a camera: their order is all one
    cameras = blocks.groupBy("camera_id").agg(F.count("*").alias("n"))
    x = F.array(*(F.lit(v) for v in (1.05, 0.02, 1.0, 0.01, 1.1, -0.5, 0.0005, 0.001)))
    steps = {0: [("Powell", "adaptive", 0.9)], 1: [("L-BFGS-B", "strict", 0.5), ("Powell", "none", 0.2)]}
    runs = spark.range(40).select((F.col("id") % 4).alias("camera_id"), F.col("id").alias("trial_id"), x.alias("x"), F.when(F.col("id") < 20, as_stages(steps[0])).otherwise(as_stages(steps[1])).alias("stages"))
    marks, by = population.Marks(blocks, cameras, cameras.limit(0).select("camera_id", F.col("n").alias("slots")), 4), ["camera_id", "trial_id"]
    at_once, by_jobs = ({(r.camera_id, r.trial_id): (list(r.x), r.value) for r in f(runs, marks, 100.0, by, 1, True).collect()} for f in (population._alone, population._in_rounds))
    apart = {k: (v, by_jobs.get(k)) for k, v in at_once.items() if v != by_jobs.get(k)}
    assert not apart, list(apart.items())[:2]
    assert len(at_once) == 40 and at_once == by_jobs


def test_blocks_valued_together_equal_blocks_alone():
    """Many small blocks and rows in one call add up to what each gives alone, bit by bit, in a fraction of the time."""
    import time

    from vistaquad.operators import rules

    rng, blocks = np.random.default_rng(6), []
    for n in (1, 2, 9, 10, 700, *[8] * 300):
        params = rng.normal(0, 1, (60, 8)) * [1.2, 0.1, 5, 0.1, 1.2, 5, 0.001, 0.001]
        params[0, 0] = np.inf
        blocks.append((params, rng.uniform(0.1, 2, 60), rng.normal(0, 90, 8 * n), rng.normal(5, 3, 4 * (n % 3))))
    began = time.perf_counter()
    together = population.blocks_values(blocks, 100.0)
    took = time.perf_counter() - began
    alone = [np.concatenate([population.block_values(p[k : k + 30], w[k : k + 30], s, a, 100.0) for k in (0, 30)]) for p, w, s, a in blocks]
    assert all((t == a).all() for t, a in zip(together, alone, strict=True)) and np.isinf(together[0][0])
    squares = population.square_values(blocks[4][0], blocks[4][2].reshape(-1, 4, 2), 100.0)
    assert (together[4][1:] == squares[1:] + blocks[4][1][1:] * population.anchor_values(blocks[4][0], blocks[4][3].reshape(-1, 4))[1:]).all() and took < 5
    steps = [{"method": m, "bounds": "strict", "weight": 0.5} for m in ("Powell", "TNC")]
    state = rules.begun(np.array([1.05, 0.02, 1.0, 0.01, 1.1, -0.5, 0.0005, 0.001]), 0, steps)
    while len(state["candidates"]):
        state = rules.advanced(state, steps, population.block_values(state["candidates"], 0.5, blocks[2][2], [], 100.0), 2)
    assert np.isfinite(state["value"])
