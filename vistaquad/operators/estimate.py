"""Homographies from point pairs: sums over blocks of points, then a small solve for each camera."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaquad.functions.geometry import ENTRIES, as_float
from vistaquad.operators.population import BROADCAST_BYTES, Marks, marks_of, met
from vistaquad.sources.schema import HOMOGRAPHY
from vistaquad.sources.shared import settle


def dlt_sums(points: DataFrame, by: tuple = ("camera_id",), add=F.sum) -> DataFrame:
    """Normal equations of the direct linear transform, as sums of products that Spark combines before the shuffle; add: the
    aggregate, such as functions.sums.fixed_sum."""
    x, y, u, v = (as_float(F.col(c)) for c in ("src_x", "src_y", "dst_x", "dst_y"))
    sums = {"xx": x * x, "xy": x * y, "yy": y * y, "xu": x * u, "xv": x * v, "xxu": x * x * u, "cross": (x * x + y * y) * (u * u + v * v)}
    return points.groupBy(*by).agg(F.count("*").alias("n"), *(add(e).alias(n) for n, e in sums.items()))


SIDES = ["src_x", "src_y", "dst_x", "dst_y"]


def _blocks(points: DataFrame) -> Marks:
    """Points, rounded to float, in settled blocks of one camera each (see population)."""
    return marks_of(None, points.select("camera_id", *((as_float(F.col(c)) + F.lit(0.0)).alias(c) for c in SIDES)))


def _summed(rows: DataFrame, function, kind: str, width: int) -> DataFrame:
    """camera_id and sums: `width` sums over blocks, of what function gives for each row of a frame."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"camera_id": frame["camera_id"], "sums": [function(r, np.asarray(r.anchors, float).reshape(-1, 4)) for r in frame.itertuples()]})

    each = rows.mapInPandas(run, f"camera_id {kind}, sums array<double>")
    return each.groupBy("camera_id").agg(F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(width))).alias("sums"))


def _normal_equations(r, p: np.ndarray) -> np.ndarray:
    """The 45 products of the normal equations, of points moved to their camera's means and over its spreads."""
    m = np.asarray(r.moments, float)
    x, y, u, v = ((p[:, i] - m[i]) / m[4 + i // 2] for i in range(4))
    zero, one = np.zeros(len(p)), np.ones(len(p))
    rows = np.concatenate([np.stack([x, y, one, zero, zero, zero, -u * x, -u * y, -u], 1), np.stack([zero, zero, zero, x, y, one, -v * x, -v * y, -v], 1)])
    return (rows.T @ rows)[np.triu_indices(9)]


def _solved(n: float, moments: np.ndarray, products: np.ndarray) -> dict | None:
    a = np.zeros((9, 9))
    a[np.triu_indices(9)] = products
    a = a + np.triu(a, 1).T
    if n < 4 or not np.isfinite(a).all():
        return None
    w, e = np.linalg.eigh(a)
    if w[1] <= 1e-12 * max(w[-1], 1e-300):
        return None
    t = [np.array([[1 / s, 0, -moments[2 * i] / s], [0, 1 / s, -moments[2 * i + 1] / s], [0, 0, 1]]) for i, s in enumerate(moments[4:])]
    h = np.linalg.inv(t[1]) @ e[:, 0].reshape(3, 3) @ t[0]
    return dict(zip(ENTRIES, (h / h[2, 2]).ravel(), strict=True)) if abs(h[2, 2]) > 1e-12 else None


def _fitted(marks: Marks, rows) -> DataFrame:
    """camera_id and h by normalised least squares. rows: blocks with what else each row needs, from marks and a table of a
    row for each camera: a function of that table or None."""
    kind = dict(marks.blocks.dtypes)["camera_id"]
    chosen = lambda r, p: p if not hasattr(r, "keep") else p[_near(np.asarray(r.keep, float)[None], p, r.limit)[0]]
    first = _summed(rows(None), lambda r, p: (lambda q: np.concatenate([[len(q)], q.sum(axis=0), (q**2).sum(axis=0)]))(chosen(r, p)), kind, 9)
    n = F.nullif(F.get("sums", F.lit(0)), F.lit(0.0))
    mean = [F.get("sums", F.lit(1 + i)) / n for i in range(4)]
    spread = [F.sqrt(F.greatest(F.lit(1e-300), sum(F.get("sums", F.lit(5 + i)) / n - mean[i] * mean[i] for i in pair)) / 2) for pair in ((0, 1), (2, 3))]
    moments = settle(first.where("sums[0] > 0").select("camera_id", F.col("sums")[0].alias("n"), F.array(*mean, *spread).alias("moments")), "moments")
    products = _summed(rows(moments.select("camera_id", "moments")), lambda r, p: _normal_equations(r, chosen(r, p)), kind, 45)

    def solve(frames):
        for frame in frames:
            yield pd.DataFrame({"camera_id": frame["camera_id"], "h": [_solved(r.n, np.asarray(r.moments, float), np.asarray(r.sums, float)) for r in frame.itertuples()]})

    return moments.join(products, "camera_id").mapInPandas(solve, f"camera_id {kind}, h {HOMOGRAPHY}")


def least_squares(points: DataFrame) -> DataFrame:
    """h of each camera by normalised least squares over all its points; null where they determine none.

    Points are settled in blocks; one pass sums the moments that normalise them, the next the 45 products of the normal
    equations, block by block, so a camera's points never meet. Points with nulls or no numbers count nothing, and a camera
    of such points alone has no row.
    """
    marks = _blocks(points)
    cameras = marks.blocks.select("camera_id").distinct().count()
    return _fitted(marks, lambda more: marks.blocks if more is None else met(more, marks, cameras))


def _near(h: np.ndarray, p: np.ndarray, limit: float) -> np.ndarray:
    """(homographies x points): whether a point lands within limit of its target."""
    with np.errstate(all="ignore"):
        moved = np.column_stack([p[:, :2], np.ones(len(p))])[None] @ h.reshape(-1, 3, 3).transpose(0, 2, 1)
        return np.sqrt(((moved[..., :2] / moved[..., 2:] - p[None, :, 2:]) ** 2).sum(axis=2)) <= limit


def _exact(src: np.ndarray, dst: np.ndarray) -> np.ndarray | None:
    rows = []
    for (x, y), (u, v) in zip(src, dst, strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y, -u], [0, 0, 0, x, y, 1, -v * x, -v * y, -v]]
    h = np.linalg.svd(np.array(rows))[2][-1]
    return h / h[8] if abs(h[8]) > 1e-9 and np.isfinite(h).all() else None


OVER = 4  # times as many points as are drawn pass the first, rough choice, so that enough do


def ransac(points: DataFrame, samples: int = 200, limit: float = 3.0, seed: int = 1) -> DataFrame:
    """h of each camera, robust: candidates from random fours, inliers counted over all points, refit on the best's.

    Of each camera 4 * samples distinct points are drawn, those of the least hash of their values: points pass a rough
    threshold where they are read, repeated ones are combined there, and only the rest travels. The fours are drawn among
    them, without one point twice; a camera's candidates are one row of bounded size. Inliers of all candidates are counted
    in one pass over blocks of points (see population), of which a hot camera has many; ties go to the earlier four. A
    camera without a result keeps its row, with a null h.
    """
    marks, pool = _blocks(points), 4 * samples
    kind = dict(points.dtypes)["camera_id"]
    plain = points.select("camera_id", *((as_float(F.col(c)) + F.lit(0.0)).alias(c) for c in SIDES)).where(" and ".join(f"abs({c}) < double('infinity')" for c in SIDES))
    hashed = plain.withColumn("_r", F.xxhash64(F.lit(seed), *SIDES))
    counts = settle(hashed.groupBy("camera_id").agg(F.approx_count_distinct("_r").alias("distinct")), "cameras")
    cameras = counts.count()
    # The share of a camera's points that pass, as a threshold of the hash; all pass where there are few.
    highest = F.when(F.col("distinct") <= OVER * pool, F.lit((1 << 63) - 1)).otherwise((F.lit(float(OVER * pool)) / F.col("distinct") * 2.0**64 - 2.0**63).cast("long"))
    thresholds = counts.select("camera_id", highest.alias("_highest"))
    passed = hashed.join(F.broadcast(thresholds) if cameras * 32 <= BROADCAST_BYTES else thresholds, "camera_id").where("_r <= _highest")
    distinct = passed.groupBy("camera_id", "_r", *SIDES).agg(F.lit(1)).select("camera_id", "_r", *SIDES)
    ranked = distinct.withColumn("_n", F.row_number().over(Window.partitionBy("camera_id").orderBy("_r", *SIDES))).where(F.col("_n") <= pool)
    # Pools and candidates travel as plain numbers, one after the other: Python gets no object for each point.
    numbers = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_n", *SIDES))), lambda p: F.array(*(p[c] for c in SIDES))))
    pools = ranked.groupBy("camera_id").agg(numbers.alias("pool"))  # of 4 * samples points at most

    def propose(frames):
        for frame in frames:
            found = []
            for rows in frame["pool"]:
                p = np.asarray(rows, float).reshape(-1, 4)
                rng, made = np.random.default_rng(seed), []
                for _ in range(samples if len(p) >= 4 else 0):
                    four = p[rng.choice(len(p), 4, replace=False)]
                    h = _exact(four[:, :2], four[:, 2:])
                    if h is not None:
                        made.append(h.ravel())
                found.append(np.concatenate(made) if made else np.zeros(0))
            yield pd.DataFrame({"camera_id": frame["camera_id"], "tried": found})

    tried = settle(pools.mapInPandas(propose, f"camera_id {kind}, tried array<double>").where(F.size("tried") > 0), "tried")
    count = lambda r, p: _near(np.asarray(r.tried, float), p, limit).sum(axis=1)
    counted = _summed(met(tried, marks, cameras), lambda r, p: np.pad(count(r, p).astype(float), (0, samples - len(r.tried) // 9)), kind, samples)
    best = F.array_max(F.transform("sums", lambda n, i: F.struct(n.alias("n"), (-i).alias("i"))))
    chosen = counted.join(tried, "camera_id").withColumn("_best", best).where("_best.n >= 4")
    kept = settle(chosen.select("camera_id", F.slice("tried", 1 - 9 * F.col("_best.i"), 9).alias("keep"), F.lit(float(limit)).alias("limit")), "best")
    found = _fitted(marks, lambda more: met(kept if more is None else kept.join(more, "camera_id"), marks, cameras))
    return points.select("camera_id").distinct().join(found, "camera_id", "left")
