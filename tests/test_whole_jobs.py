"""Registered jobs without SQL, over all rows of small tables."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from plain import mapped, objective, quad_metrics
from pyspark.sql import functions as F

from vistaquad.functions.geometry import homography
from vistaquad.operators import population, search
from vistaquad.plans import standins as s
from vistaquad.plans.registry import QUERIES

PARTS, VECTORS = 50, 3


@pytest.fixture(scope="module")
def small(tmp_path_factory):
    """Tables part and embeddings of 50 points and 24 quads, enough for two cameras."""
    path, rng = tmp_path_factory.mktemp("small"), np.random.default_rng(4)
    part = {"p_partkey": np.arange(PARTS) + 1000, "p_size": rng.integers(1, 50, PARTS).astype(np.int32), "p_retailprice": rng.uniform(900, 2000, PARTS).round(2)}
    vectors = {"vec_id": np.arange(VECTORS) + 500, "embedding": list(rng.normal(0, 0.2, (VECTORS, 64)).astype(np.float32))}
    for name, rows in (("part", part), ("embeddings", vectors)):
        pq.write_table(pa.table(rows), path / f"{name}.parquet")
    return path, part, vectors


def cameras(small, n=2):
    """Marks and quads of each camera, from the tables alone."""
    _, part, vectors = small
    src = np.stack([part["p_size"], part["p_retailprice"]], axis=1).astype(np.float32).astype(float)
    dst = mapped(np.array(s.H_SECOND[:8]), src)
    corners = (np.stack(vectors["embedding"]).astype(float) * 1000).reshape(-1, 4, 2).astype(np.float32).astype(float)
    of_quad = (vectors["vec_id"][:, None] * 8 + np.arange(8)).ravel() % n
    return {c: (src[part["p_partkey"] % n == c], dst[part["p_partkey"] % n == c], corners[of_quad == c]) for c in range(n)}


START = np.array(s.H_SECOND[:8]) * 1.02


def test_refine_covers_all_rows(spark, small):
    got = {r.camera_id: r for r in QUERIES["q29_refine"](spark, str(small[0])).collect()}
    want = cameras(small)
    assert set(got) == set(want) and sum(len(q) for _, _, q in want.values()) == VECTORS * 8 and sum(len(x) for x, _, _ in want.values()) == PARTS
    for c, (src, dst, quads) in want.items():
        before = objective(START, quads, src, dst, 0.5, 100.0)
        assert got[c].error is None and got[c].objective < before
        # The result's objective, from all the camera's rows.
        found = np.array([got[c][k] for k in ("h00", "h01", "h02", "h10", "h11", "h12", "h20", "h21")])
        assert got[c].objective == pytest.approx(objective(found, quads, src, dst, 0.5, 100.0), rel=1e-6)


def test_search_covers_all_cameras_and_rows(spark, small):
    rows = QUERIES["q30_search"](spark, str(small[0])).collect()
    want = cameras(small)
    trials = {(int(r.camera_id), r.trial_id): r.stages for r in search.sample(spark.range(2).withColumnRenamed('id', 'camera_id'), 6).collect()}
    assert {(r.camera_id, r.trial_id) for r in rows} == set(trials) and len(rows) == 12
    for r in rows:
        src, dst, quads = want[r.camera_id]
        assert r.success == (r.levels > 1) and (r.success or "one level" in r.error)
        if r.success:
            off = lambda p: np.linalg.norm(mapped(p, src) - dst, axis=1).mean()  # noqa: B023, E731
            assert r.squares_count == len(quads) and r.initial_error == pytest.approx(off(START), rel=1e-4)
            assert all(x.weight >= 0.05 for x in trials[r.camera_id, r.trial_id]) and r.optimized_error > 0


def test_topmost_corner_of_equals_is_the_leftmost():
    quads = np.random.default_rng(0).integers(0, 3, (500, 4, 2)).astype(float)

    def slow(q):
        i = min(range(4), key=lambda j: (q[j][1], q[j][0], j))
        q = np.roll(q, -i, axis=0) - q[i]
        t = -np.arctan2(q[1, 1], q[1, 0])
        x, y = q[:, 0] * np.cos(t) - q[:, 1] * np.sin(t), q[:, 0] * np.sin(t) + q[:, 1] * np.cos(t)
        return np.hypot(x[1] - 100, y[1] - 100) + np.hypot(x[2] - 100, y[2]) + 100

    assert quad_metrics(quads, 100.0) == pytest.approx(np.array([slow(q) for q in quads]))


def some_cameras(spark, n=5000):
    """Marks of three cameras, of which the first has nearly all, among them some that count nothing."""
    rng = np.random.default_rng(8)
    quads = rng.uniform(0, 300, (n, 4, 2)).astype(np.float32).astype(float)
    pairs = rng.uniform(0, 300, (n, 4))
    of = np.where(np.arange(n) % 50 == 0, 1, np.where(np.arange(n) % 50 == 1, 2, 0))
    corners = "camera_id long, corners array<struct<x:double,y:double>>"
    squares = spark.createDataFrame([(int(c), [tuple(map(float, p)) for p in q]) for c, q in zip(of, quads, strict=True)] + [(0, None), (1, [(1.0, None)] * 4), (2, [(1.0, 1.0)])], corners)
    anchors = spark.createDataFrame([(int(c), *map(float, p)) for c, p in zip(of, pairs, strict=True)] + [(0, None, 1.0, 1.0, 1.0), (1, float("nan"), 1.0, 1.0, 1.0)], "camera_id long, src_x double, src_y double, dst_x double, dst_y double")
    return of, quads, pairs, squares.repartition(6), anchors.repartition(6)


@pytest.mark.parametrize("small", [True, False])
def test_objectives_of_a_hot_camera(spark, monkeypatch, small):
    """Blocks of one camera meet its candidates in several places; both ways of the join give the plain objective."""
    monkeypatch.setattr(population, "SLOT", 1)
    of, quads, pairs, squares, anchors = some_cameras(spark)
    marks = population.marks_of(squares, anchors)
    assert marks.slots.where("camera_id = 0").first().slots > 3
    assert marks.blocks.agg(F.max(F.size("squares"))).first()[0] <= 8 * population.BLOCK
    tried = [START * (1 + 0.01 * i) for i in range(4)]
    asked = spark.range(3).select(F.col("id").alias("camera_id"), F.lit(7).alias("trial_id"), F.lit(0.4).alias("weight"), F.array(*(F.array(*map(F.lit, map(float, t))) for t in tried)).alias("candidates"))
    got = population.objectives(asked, marks, ["camera_id", "trial_id"], 100.0, runs=3 if small else None)
    got = {(r.camera_id, r.candidate): r.value for r in got.collect()}
    for c in range(3):
        for i, t in enumerate(tried):
            own = of == c
            assert got[c, i] == pytest.approx(objective(t, quads[own], pairs[own, :2], pairs[own, 2:], 0.4, 100.0), rel=1e-9)


def test_nothing_gathers_a_camera(spark):
    """The plan of a round has no collect_list but that of a run's candidates."""
    _, _, _, squares, anchors = some_cameras(spark, 100)
    start = spark.range(3).select(F.col("id").alias("camera_id"), homography(list(START)).alias("h"))
    marks = population.marks_of(squares, anchors)
    asked = start.select("camera_id", F.lit(1.0).alias("weight"), F.array(population.params_of(F.col("h"))).alias("candidates"))
    plan = population.objectives(asked, marks, ["camera_id"], 100.0)._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "partial_sum" in plan
