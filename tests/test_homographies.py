"""First homographies of the registered queries against plain solutions, camera by camera."""

from pathlib import Path

import numpy as np
import pytest
from plain import mapped

from vistaquad.functions.geometry import ENTRIES
from vistaquad.operators import estimate
from vistaquad.plans import registry
from vistaquad.sources import schema

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


def plain(src, dst):
    """Normalised direct linear transform by singular values."""

    def normal(p):
        middle, spread = p.mean(axis=0), np.sqrt(((p - p.mean(axis=0)) ** 2).sum() / len(p) / 2)
        t = np.array([[1 / spread, 0, -middle[0] / spread], [0, 1 / spread, -middle[1] / spread], [0, 0, 1]])
        return t, (p - middle) / spread

    (t, p), (s, q) = normal(src), normal(dst)
    rows = []
    for (x, y), (u, v) in zip(p, q, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.inv(s) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ t
    return h / h[2, 2]


@pytest.fixture
def marks(spark):
    by: dict = {}
    for r in registry._marks(spark, SF).collect():
        by.setdefault(r.camera_id, []).append((r.src_x, r.src_y, r.dst_x, r.dst_y, r.l_linenumber))
    return {c: np.array(rows, np.float32).astype(float) for c, rows in by.items()}


@needs_tables
def test_least_squares_of_every_camera(spark, marks):
    got = {r.camera_id: r for r in registry.QUERIES["q34_homography"](spark, SF).collect()}
    assert set(got) == set(marks)
    for c, rows in marks.items():
        rows[rows[:, 4] == 7, 2:4] -= [500, -500]
        want = plain(rows[:, :2], rows[:, 2:4])
        mine = np.array([got[c][e] for e in ENTRIES])
        a, b = (mapped(h[:8], rows[:, :2]) for h in (mine, want.ravel()))
        assert (np.abs(a - b) / (1 + np.abs(b))).max() < 1e-3, c


@needs_tables
def test_robust_homographies_leave_far_points_out(spark, marks):
    got = {r.camera_id: r for r in registry.QUERIES["q35_ransac"](spark, SF).collect()}
    assert set(got) == set(marks)
    for c, rows in marks.items():
        near = rows[rows[:, 4] != 7]
        h = np.array([got[c][e] for e in ENTRIES[:8]], float)
        off = np.linalg.norm(mapped(h, near[:, :2]) - near[:, 2:4], axis=1)
        assert np.median(off) < 1, (c, np.median(off))


def test_thousands_of_points_with_outliers(spark):
    """A camera of 5,000 points of which 40 in 100 are off; every one counts."""
    true, rng = np.array([1.1, 0.05, 12, -0.03, 0.95, 7, 1e-4, -5e-5]), np.random.default_rng(5)
    src = rng.uniform(0, 400, (5000, 2))
    dst = mapped(true, src) + rng.normal(0, 0.2, (5000, 2))
    dst[::5] += rng.uniform(50, 300, (1000, 2))
    dst[1::5] -= rng.uniform(50, 300, (1000, 2))
    rows = [("c", i, *map(float, (*s, *d))) for i, (s, d) in enumerate(zip(src, dst, strict=True))]
    h = estimate.ransac(spark.createDataFrame(rows, schema.POINTS), samples=100).first().h
    assert np.abs(mapped(np.array([h[e] for e in ENTRIES[:8]]), src) - mapped(true, src)).max() < 0.5
