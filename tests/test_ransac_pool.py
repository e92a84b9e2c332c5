"""Robust estimation where one point is repeated, and for cameras without a result."""

import numpy as np
from plain import mapped

from vistaquad.functions.geometry import ENTRIES
from vistaquad.operators import estimate
from vistaquad.sources import schema

TRUE = np.array([1.1, 0.05, 12, -0.03, 0.95, 7, 1e-4, -5e-5])


def test_every_point_repeated_and_a_camera_without_a_result(spark):
    src = np.random.default_rng(3).uniform(0, 400, (40, 2))
    dst = mapped(TRUE, src)
    # Whichever point has the least hash, its copies alone are more than 64.
    rows = [("c", i, *map(float, (*s, *d))) for i, (s, d) in enumerate(zip(src, dst, strict=True)) for _ in range(80)]
    rows += [("few", i, float(i), 0.0, float(i), 0.0) for i in range(3)]
    found = {r.camera_id: r.h for r in estimate.ransac(spark.createDataFrame(rows, schema.POINTS), samples=60).collect()}
    assert set(found) == {"c", "few"} and found["few"] is None and found["c"] is not None
    grid = np.stack(np.meshgrid(np.arange(0, 400, 40), np.arange(0, 400, 40)), -1).reshape(-1, 2).astype(float)
    assert np.abs(mapped(np.array([found["c"][n] for n in ENTRIES[:8]]), grid) - mapped(TRUE, grid)).max() < 0.1


def test_a_hot_camera_and_one_hot_point(spark):
    """A camera of 60,000 points, a third of them one point, half of the others far off; beside it a small one."""
    rng = np.random.default_rng(7)
    src = rng.uniform(0, 400, (60_000, 2))
    src[::3] = src[0]
    dst = mapped(TRUE, src) + rng.normal(0, 0.2, src.shape) * (np.arange(len(src)) % 3 > 0)[:, None]
    dst[1::3] += rng.uniform(40, 200, dst[1::3].shape)
    rows = [("hot", i, *map(float, (*s, *d))) for i, (s, d) in enumerate(zip(src, dst, strict=True))]
    rows += [("small", i, *map(float, (*s, *d))) for i, (s, d) in enumerate(zip(src[2:60:3], dst[2:60:3], strict=True))] + [("small", 99, None, 1.0, 1.0, 1.0), ("void", 1, float("nan"), 0.0, 0.0, 0.0)]
    points = spark.createDataFrame(rows, schema.POINTS).repartition(6)
    found = {r.camera_id: r.h for r in estimate.ransac(points, samples=80).collect()}
    assert set(found) == {"hot", "small", "void"} and found["void"] is None
    for h in (found["hot"], found["small"]):
        assert np.abs(mapped(np.array([h[n] for n in ENTRIES[:8]]), src[:300]) - mapped(TRUE, src[:300])).max() < 1
    first = estimate.ransac(points, samples=80).where("camera_id = 'hot'").first().h
    assert np.allclose([first[n] for n in ENTRIES], [found["hot"][n] for n in ENTRIES], rtol=1e-9)


def test_python_gets_plain_numbers(spark, monkeypatch):
    """Pools and candidates reach Python as arrays of doubles, whose size is known, not as an object for each point."""
    frame, seen = type(spark.range(0)), []
    plain = frame.mapInPandas
    monkeypatch.setattr(frame, "mapInPandas", lambda self, *a, **b: seen.append(dict(self.dtypes)) or plain(self, *a, **b))
    rows = spark.range(200).selectExpr("id % 2 as camera_id", "id * 7 % 31 * 1.0d as src_x", "id * 11 % 37 * 1.0d as src_y", "id * 7 % 31 + 3.0d as dst_x", "id * 11 % 37 - 2.0d as dst_y")
    found = estimate.ransac(rows, samples=20).collect()
    assert len(found) == 2 and all(abs(r.h.h02 - 3) < 1e-6 and abs(r.h.h12 + 2) < 1e-6 for r in found)
    assert {kind for kinds in seen for c, kind in kinds.items() if c in ("pool", "tried", "keep")} == {"array<double>"}
