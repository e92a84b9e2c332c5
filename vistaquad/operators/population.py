"""Refinement by populations: every round, all candidates of all runs are valued over all marks.

A run is one camera's refinement under one list of levels; its state is a row of bounded size. Marks (quads and anchors)
are settled once in blocks of at most BLOCK marks of one camera. In a round, blocks meet the candidates of their camera, a
block's sums by candidate are worked out at once, and Spark adds them up by run and candidate; the states that follow are
settled, so a lost executor repeats part of one round. A camera of many marks has many blocks, which are dealt out. Where
a camera has SLOT blocks or fewer, a few of its runs and all its blocks meet in one group, with those of a few other such
cameras, which takes all its rounds there.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import ENTRIES, EPSILON, as_float
from vistaquad.operators import rules
from vistaquad.sources.schema import STAGES
from vistaquad.sources.shared import settle

TURNS = 8  # of a level; each is a probe and a leap, so two rounds
BLOCK = 2048  # marks of a block
SLOT, HEAVY = 32, 2000  # blocks of a camera that meet its candidates in one place; cameras beyond that, at most
TOGETHER, BUCKET = 8, 16  # runs of a camera, about, that take their rounds side by side; cameras, about, of one group of rows
CHUNK = 3840  # quads that are valued at once, where blocks are smaller
RUN_BYTES, BROADCAST_BYTES = 16_384, 1 << 26  # of a run's candidates at most; of all that are broadcast

STATE = "level int, turn int, leaps boolean, x array<double>, value double, basis array<double>, bounds array<double>, candidates array<array<double>>"


@dataclass
class Marks:
    """Settled blocks, how many (n) each camera has, the slots of the cameras of many blocks (HEAVY rows at most), and how many
    parts joins are cut into."""

    blocks: DataFrame
    cameras: DataFrame
    slots: DataFrame
    parts: int


def _packed(kind: str):
    """Rows (camera_id, numbers), sorted by camera, to blocks of one camera each."""

    def run(frames):
        for frame in frames:
            out = []
            for camera, own in frame.groupby("camera_id", sort=False, dropna=False)["numbers"]:
                for at in range(0, len(own), BLOCK):
                    out.append((camera, np.concatenate(own.iloc[at : at + BLOCK].to_numpy())))
            empty = [np.zeros(0)] * len(out)
            columns = {"camera_id": [c for c, _ in out], "squares": [b for _, b in out], "anchors": empty}
            if kind == "anchors":
                columns["squares"], columns["anchors"] = columns["anchors"], columns["squares"]
            yield pd.DataFrame(columns)

    return run


def marks_of(squares: DataFrame | None, anchors: DataFrame) -> Marks:
    """squares: camera_id, corners; anchors: camera_id, src_x.. dst_y. Marks with a null or no number in them count nothing.

    Marks are dealt out by ranges of camera and row, so a small camera's stay together and a large one's are spread.
    """
    spark = anchors.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    corner = lambda k, f: as_float(F.get("corners", F.lit(k))[f])
    quads = None if squares is None else squares.where(F.size("corners") == 4).select("camera_id", F.array(*(corner(k, f) for k in range(4) for f in "xy")).alias("numbers"))
    pairs = anchors.select("camera_id", F.array(*(F.col(c).cast("double") for c in ("src_x", "src_y", "dst_x", "dst_y"))).alias("numbers"))
    kinds = [dict(anchors.dtypes)["camera_id"], "array<double>"]

    def blocks(rows: DataFrame, kind: str) -> DataFrame:
        whole = rows.where(F.forall("numbers", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
        spread = whole.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(parts, "camera_id", "row").sortWithinPartitions("camera_id")
        return spread.drop("row").mapInPandas(_packed(kind), f"camera_id {kinds[0]}, squares {kinds[1]}, anchors {kinds[1]}")

    found = blocks(pairs, "anchors")
    found = found if quads is None else blocks(quads, "squares").unionAll(found)
    found = settle(found.withColumn("block", F.monotonically_increasing_id()), "blocks")
    n = settle(found.groupBy("camera_id").agg(F.count("*").alias("n")), "cameras")
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slot = max(SLOT, -(-total // HEAVY))
    slots = n.where(F.col("n") > slot).select("camera_id", F.ceil(F.col("n") / slot).alias("slots"))
    return Marks(found, n, settle(slots, "slots"), max(parts, total // SLOT))


def _moved(params: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """marks (k x 3 x n: k planes of x, y and 1) under each row of eight parameters, as k x 3 x rows x n."""
    h = np.column_stack([params, np.ones(len(params))]).reshape(-1, 3, 3).transpose(1, 0, 2).reshape(-1, 3)
    return (h @ marks).reshape(len(marks), 3, len(params), -1)


def _planes(points: np.ndarray) -> np.ndarray:
    """n x k x 2 numbers as k planes (see _moved)."""
    return np.ascontiguousarray(np.concatenate([points, np.ones((*points.shape[:2], 1))], axis=2).transpose(1, 2, 0))


def _topmost(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of four corners (the first axis) is the topmost, of equals the leftmost, of those the first."""
    least = np.minimum(np.minimum(y[0], y[1]), np.minimum(y[2], y[3]))
    across = np.where(y == least, x, np.inf)
    if not np.isfinite(x).all():
        return across.argmin(axis=0)
    first, best = np.zeros(least.shape, np.int64), across[0]
    for k in (1, 2, 3):
        first[across[k] < best] = k
        best = np.minimum(best, across[k])
    return first


def _under(params: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """n x 4 x 2 quads under each row of parameters, as 4 x 3 x (rows * n)."""
    n = len(squares)
    squares = np.repeat(squares, 2, axis=0) if n == 1 else squares  # a product with one column is rounded otherwise
    return _moved(params, _planes(squares))[..., :n].reshape(4, 3, -1)


def _metrics(moved: np.ndarray, size: float, compat: bool) -> np.ndarray:
    """Square metric (see quads.metric) of each quad of moved (see _under). What turning a quad about its first vertex gives
    is told by dot and cross products with its first side."""
    w = np.ascontiguousarray(moved[:, 2])
    near = ~(np.abs(w) > EPSILON)
    some = near.any()
    x, y = ((np.where(near, 0.0, moved[:, i] / w) if some else moved[:, i] / w).astype(np.float32).astype(float) for i in (0, 1))
    first, every = _topmost(x, y), np.arange(x.shape[1])
    corner = lambda k: ((first + k) & 3) * x.shape[1] + every  # noqa: E731 - its place among all numbers of x and y
    x0, y0 = x.take(corner(0)), y.take(corner(0))
    (bx, by), (cx, cy) = ((x.take(at) - x0, y.take(at) - y0) for at in map(corner, (1, 2)))
    side = np.sqrt(bx * bx + by * by)
    some = side > 0
    length = np.where(some, side, 1)
    tx, ty = np.where(some, bx / length, 1.0), np.where(some, by / length, 0.0)
    off = lambda u, v: np.sqrt(u * u + v * v)
    if compat:
        return off(side - size, 0.0 - size) + off(cx * tx + cy * ty - size, cy * tx - cx * ty) + size
    dx, dy = x.take(corner(3)) - x0, y.take(corner(3)) - y0
    return off(side - size, 0.0) + off(cx * tx + cy * ty - size, cy * tx - cx * ty - size) + off(dx * tx + dy * ty, dy * tx - dx * ty - size)


def anchor_values(params: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Sum of distances of n x 4 (source and target) under each row of parameters; not rounded to float."""
    with np.errstate(all="ignore"):
        x, y, w = _moved(params, _planes(anchors[:, None, :2]))[0]
        x, y = x / w - anchors[:, 2], y / w - anchors[:, 3]
        return np.sqrt(x * x + y * y).sum(axis=1)


def blocks_values(asked: list, size: float, compat: bool = True) -> list:
    """What each block adds to the objective, for asked (parameters, weight, squares, anchors), under each row of its
    parameters; infinite where that isn't a number. weight is one for all rows or one for each.

    Few rows and blocks of few squares are valued together, about CHUNK quads at once, whose numbers stay in the processor's
    cache: each sum is that of the row and block alone, bit by bit.
    """
    totals = [np.zeros(len(params)) for params, *_ in asked]
    pending: list = []

    def settled() -> None:
        apart = _metrics(np.concatenate([m for _, m in pending], axis=2) if len(pending) > 1 else pending[0][1], size, compat)
        for total, m in pending:
            total += apart[: m.shape[2]].reshape(len(total), -1).sum(axis=1)
            apart = apart[m.shape[2] :]
        pending.clear()

    def sliced(params: np.ndarray, marks: int, most: int):
        """Slices of the rows of params, so that no slice has more than most pairs of row and mark, but for one row alone."""
        rows = max(1, most // marks)
        return [slice(at, at + rows) for at in range(0, len(params), rows)]

    with np.errstate(all="ignore"):
        held = 0
        for total, (params, _, squares, _) in zip(totals, asked, strict=True):
            quads = np.asarray(squares).reshape(-1, 4, 2)
            for rows in sliced(params, len(quads), CHUNK) if len(quads) else []:
                moved = _under(params[rows], quads)
                if pending and held + moved.shape[2] > CHUNK:
                    settled()
                    held = 0
                pending.append((total[rows], moved))
                held += moved.shape[2]
        if pending:
            settled()
        for total, (params, weight, _, anchors) in zip(totals, asked, strict=True):
            if len(anchors):
                anchors = np.asarray(anchors).reshape(-1, 4)
                total += weight * np.concatenate([anchor_values(params[rows], anchors) for rows in sliced(params, len(anchors), 4 * CHUNK)])
    return [np.where(np.isfinite(total), total, np.inf) for total in totals]


def square_values(params: np.ndarray, squares: np.ndarray, size: float, compat: bool = True) -> np.ndarray:
    """Sum of square metrics (see quads.metric) of n x 4 x 2 quads under each row of eight parameters."""
    with np.errstate(all="ignore"):
        return _metrics(_under(params, squares), size, compat).reshape(len(params), -1).sum(axis=1)


def block_values(params: np.ndarray, weight, squares, anchors, size: float, compat: bool = True) -> np.ndarray:
    """blocks_values of one block."""
    return blocks_values([(params, weight, squares, anchors)], size, compat)[0]


def met(asked: DataFrame, marks: Marks, runs: int | None = None) -> DataFrame:
    """Every block with the rows of asked (camera_id and more) of its camera.

    runs: how many rows asked has at most; where that keeps all of them below BROADCAST_BYTES they go to the blocks, else
    both are dealt out by camera and slot.
    """
    if runs is not None and runs * RUN_BYTES <= BROADCAST_BYTES:
        return marks.blocks.join(F.broadcast(asked), "camera_id")
    slots, heavy = F.coalesce("slots", F.lit(1).cast("long")), F.broadcast(marks.slots)
    spread = asked.join(heavy, "camera_id", "left").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), slots - 1))).drop("slots")
    blocks = marks.blocks.join(heavy, "camera_id", "left").withColumn("slot", F.pmod("block", slots)).drop("slots")
    key = ["camera_id", "slot"]
    return blocks.repartition(marks.parts, *key).join(spread.repartition(marks.parts, *key), key)


def objectives(asked: DataFrame, marks: Marks, by: list, size: float, compat: bool = True, runs: int | None = None) -> DataFrame:
    """by, candidate and value: sum of square metrics + weight * sum of anchor distances, for each candidate.

    asked: by (camera_id among them), weight, candidates (array of eight parameters each); runs: see met. A value that
    isn't a number counts as infinite; candidates of a camera without marks have no row.
    """

    def valued(frames):
        for frame in frames:
            sums = [block_values(_listed(r.candidates), r.weight, r.squares, r.anchors, size, compat) for r in frame.itertuples()]
            yield pd.DataFrame({**{k: frame[k] for k in by}, "values": sums})

    kinds = dict(asked.dtypes)
    parts = met(asked, marks, runs).select(*by, "weight", "candidates", "squares", "anchors").mapInPandas(valued, ", ".join([*(f"{k} {kinds[k]}" for k in by), "values array<double>"]))
    return parts.select(*by, F.posexplode("values").alias("candidate", "value")).groupBy(*by, "candidate").agg(F.sum("value").alias("value"))


def _listed(rows) -> np.ndarray:
    return np.array([np.asarray(r, float) for r in rows], float).reshape(-1, 8)


def _state(r) -> dict:
    return {"level": int(r.level), "turn": int(r.turn), "leaps": bool(r.leaps), "x": np.asarray(r.x, float), "value": float(r.value), "basis": np.asarray(r.basis, float).reshape(-1, 8), "bounds": None if r.bounds is None else np.asarray(r.bounds, float).reshape(8, 2), "candidates": _listed(r.candidates)}


def _row(state: dict) -> dict:
    return state | {"x": state["x"].tolist(), "basis": state["basis"].ravel().tolist(), "bounds": None if state["bounds"] is None else state["bounds"].ravel().tolist(), "candidates": state["candidates"].tolist()}


def _alone(runs: DataFrame, marks: Marks, size: float, by: list, turns: int, compat: bool) -> DataFrame:
    """optimised for runs of cameras of SLOT blocks or fewer, some cameras' runs through all their rounds at once."""
    kinds = dict(runs.dtypes)
    names = [*by, "x", "value"]

    def through(frame, blocks):
        """All runs side by side: in a round, the candidates of a camera's runs meet each of its blocks in one call."""
        kept: dict = {}
        for b in blocks.itertuples():
            kept.setdefault((b.camera_id, b.group), []).append((b.squares, b.anchors))
        cameras = [(list(own.itertuples()), kept.get(key, [])) for key, own in frame.groupby(["camera_id", "group"], sort=False, dropna=False)]
        states = [[rules.begun(np.asarray(r.x, float), 0, r.stages) for r in rows] for rows, _ in cameras]
        while True:
            going, asked = [], []
            for c, (rows, own) in enumerate(cameras):
                if active := [i for i, s in enumerate(states[c]) if len(s["candidates"])]:
                    sizes = [len(states[c][i]["candidates"]) for i in active]
                    params = np.concatenate([states[c][i]["candidates"] for i in active])
                    weights = [rows[i].stages[states[c][i]["level"]]["weight"] for i in active]
                    weight = np.repeat([np.nan if w is None else w for w in weights], sizes)
                    going.append((c, active, sizes))
                    asked += [(params, weight, squares, anchors) for squares, anchors in own]
            if not going:
                break
            found = iter(blocks_values(asked, size, compat))
            for c, active, sizes in going:
                values = np.zeros(sum(sizes))
                for _ in cameras[c][1]:
                    values = values + next(found)
                at = 0
                for i, n in zip(active, sizes, strict=True):
                    states[c][i] = rules.advanced(states[c][i], cameras[c][0][i].stages, values[at : at + n], turns)
                    at += n
        out = [{k: getattr(r, k) for k in by} | {"x": s["x"].tolist(), "value": s["value"]} for (rows, _), own in zip(cameras, states, strict=True) for r, s in zip(rows, own, strict=True)]
        return pd.DataFrame(out, columns=names)

    groups = settle(runs.groupBy("camera_id").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("groups")), "groups")
    buckets = max(4 * marks.parts, groups.agg(F.coalesce(F.sum("groups"), F.lit(0))).first()[0] // BUCKET)
    bucket = F.pmod(F.xxhash64("camera_id", "group"), F.lit(buckets)).alias("bucket")
    dealt = runs.join(groups.hint("merge"), "camera_id", "left").withColumn("group", F.pmod(F.xxhash64(*by), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups").select("*", bucket)
    blocks = marks.blocks.join(groups.hint("merge"), "camera_id").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).select("camera_id", "group", bucket, "squares", "anchors")
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), "x array<double>", "value double"])
    return dealt.repartition(marks.parts, "bucket").groupBy("bucket").cogroup(blocks.repartition(marks.parts, "bucket").groupBy("bucket")).applyInPandas(through, schema)


def optimised(runs: DataFrame, marks: Marks, size: float, by: list, turns: int = TURNS, compat: bool = True) -> DataFrame:
    """by, x (eight parameters) and value (the last level's objective) of each run of runs (by, x, stages).

    Each level has `turns` turns, and begins where the one before ended. Runs go on side by side; one with fewer levels
    is through earlier. A run without marks keeps its parameters, moved into its bounds. Methods and bounds must be known.
    """
    large = settle(marks.cameras.where(F.col("n") > SLOT).select("camera_id"), "large")
    small = _alone(runs.join(large, "camera_id", "left_anti"), marks, size, by, turns, compat)
    if large.isEmpty():
        return small
    return small.unionByName(_in_rounds(runs.join(large, "camera_id", "left_semi"), marks, size, by, turns, compat))


def _in_rounds(runs: DataFrame, marks: Marks, size: float, by: list, turns: int, compat: bool) -> DataFrame:
    """optimised for runs of any cameras, a job for each round."""
    kinds = dict(runs.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in by), f"stages {STAGES}", STATE])
    names = [*by, "stages", *_row(rules.begun(np.ones(8), 0, [{"method": "Powell", "bounds": "none"}]))]
    keys = lambda r: {k: getattr(r, k) for k in by} | {"stages": r.stages}

    def first(frames):
        for frame in frames:
            yield pd.DataFrame([keys(r) | _row(rules.begun(np.asarray(r.x, float), 0, r.stages)) for r in frame.itertuples()], columns=names)

    def following(frames):
        for frame in frames:
            out = []
            for r in frame.itertuples():
                state = _state(r)
                if len(state["candidates"]):
                    values = np.zeros(len(state["candidates"])) if r.values is None else np.asarray(r.values, float)
                    state = rules.advanced(state, r.stages, values, turns)
                out.append(keys(r) | _row(state))
            yield pd.DataFrame(out, columns=names)

    states = settle(runs.select(*by, "stages", "x").mapInPandas(first, schema), "runs")
    levels, n = states.agg(F.coalesce(F.max(F.size("stages")), F.lit(0)), F.count("*")).first()
    for _ in range(2 * turns * levels):
        asked = states.where(F.size("candidates") > 0).select(*by, F.get("stages", F.col("level"))["weight"].alias("weight"), "candidates")
        found = objectives(asked, marks, by, size, compat, n)
        values = found.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("candidate", "value"))), lambda c: c["value"]).alias("values"))
        states = settle(states.join(values, by, "left").mapInPandas(following, schema), "runs")
    return states.select(*by, "x", "value")


def params_of(h: Column) -> Column:
    """Eight parameters of a homography, divided by h22; null where that is 0."""
    values = F.array(*(h[n] / F.nullif(h["h22"], F.lit(0.0)) for n in ENTRIES[:8]))
    return F.when(h.isNotNull() & (h["h22"] != 0), values)


def wrong_stages(stages: Column) -> Column:
    """What is wrong with a list of levels; null if nothing is."""
    method = F.filter(stages, lambda s: ~s["method"].isin(rules.METHODS) | s["method"].isNull())
    mode = F.filter(stages, lambda s: ~s["bounds"].isin(rules.MODES) | s["bounds"].isNull())
    return F.when(F.size(mode) > 0, F.lit("ValueError: bounds must be none, strict or adaptive")).when(F.size(method) > 0, F.lit("ValueError: unknown method")).when(F.size(stages) < 1, F.lit("ValueError: at least one level is needed"))
