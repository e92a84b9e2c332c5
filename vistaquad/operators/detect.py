"""Detection of calibration squares as Spark jobs: runs of dark pixels by windows, parts by joins of runs, borders and
corners of one part or place at a time in small Python helpers, and filters as column expressions.

An image lies packed in its row, and no pixel becomes one: a helper unpacks a band of rows, or the pixels about corners, or
gets the runs of one dark part.

Runs, links and sizes grow with the number of images, and their sizes on disk tell little of that in memory, so joins
between them are merged (see _merged): none of them goes through the driver to be broadcast.
"""

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaquad.functions import quads
from vistaquad.operators.raster import blur, gray
from vistaquad.sources.images import array_of, explode
from vistaquad.sources.schema import QUAD
from vistaquad.sources.shared import settle

# The eight neighbours of a pixel (down, right), clockwise from the right one.
AROUND = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


SIDE = 1 << 20  # a pixel's number is y * SIDE + x
BAND = 64  # rows of an image whose runs are merged in one task
OUTER = -1  # the ground that reaches the border of the image
HALF = 5  # of the window about a corner, which is also how far the corner may move
REACH = 2 * HALF + 3  # pixels about a corner that its refinement can look at
MOST_RUNS, SOME_SQUARES = 100_000, 512  # runs that a task holds before it hands them on; squares that are refined at once


def _merged(rows: DataFrame) -> DataFrame:
    """rows, to be joined by sorting both sides, whatever their size is believed to be."""
    return rows.hint("merge")


def gray_pixels(images: DataFrame) -> DataFrame:
    """image_id, y, x, v"""
    return explode(images).select("image_id", "y", "x", gray(F.col("b"), F.col("g"), F.col("r")).alias("v"))


def dark_runs(pixels: DataFrame, level: int = 140) -> DataFrame:
    """Runs of pixels of a row on one side of level, after blurring: image_id, y, a and b (first and last x), dark."""
    row = Window.partitionBy("image_id", "y").orderBy("x")
    sided = blur(pixels, "v").withColumn("dark", F.col("blur") <= level)
    begins = F.coalesce(F.col("dark") != F.lag("dark").over(row), F.lit(True)).cast("int")
    numbered = sided.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(row))
    return numbered.groupBy("image_id", "y", "_run").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.first("dark").alias("dark")).drop("_run")


def components(links: DataFrame) -> DataFrame:
    """Connected parts of links (image_id, u, v): image_id, node and part, its smallest node, for every node with a link.

    In turn, each node's larger neighbours are linked with its smallest one, and its smaller ones, until the links no
    longer change. Both aggregate before they shuffle, and each round is settled.
    """
    key = ["image_id", "u"]

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        if larger:
            around = edges.union(edges.select("image_id", F.col("v"), F.col("u")))
        else:
            around = edges.select("image_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = around.groupBy(*key).agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = around.join(_merged(least), key)
        if larger:
            return joined.where("v > u").select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return joined.select("image_id", F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("image_id", "u", F.col("m").alias("v"))).where("u <> v").distinct()

    edges, before = settle(links.select("image_id", "u", "v").where("u <> v").distinct(), "edges"), None
    while True:
        edges = settle(star(star(edges, True), False), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("image_id", "u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select("image_id", F.col("u").alias("node"), F.col("v").alias("part"))
        before = now


def _joined(y: np.ndarray, a: np.ndarray, b: np.ndarray, dark: np.ndarray) -> np.ndarray:
    """For runs sorted by row and column, the first run of the connected part of each: touching runs of neighbouring rows
    are merged, later ones into earlier ones."""
    first, (y, a, b, dark) = list(range(len(y))), (c.tolist() for c in (y, a, b, dark))

    def root(i: int) -> int:
        while first[i] != i:
            first[i] = first[first[i]]
            i = first[i]
        return i

    begins = {row: i for i, row in reversed(list(enumerate(y)))}
    for row, i in begins.items():
        j = begins.get(row - 1)
        while j is not None and i < len(y) and j < len(y) and y[i] == row and y[j] == row - 1:
            if dark[i] == dark[j] and a[i] <= b[j] + dark[i] and a[j] <= b[i] + dark[i]:
                low, high = sorted((root(i), root(j)))
                first[high] = low
            if b[i] + dark[i] < b[j] + dark[j] or (b[i] == b[j] and dark[i] < dark[j]):
                i += 1
            else:
                j += 1
    return np.array([root(i) for i in range(len(y))], np.int64)


def _roots(y: np.ndarray, a: np.ndarray, b: np.ndarray, dark: np.ndarray) -> np.ndarray:
    """_joined for runs of both sides of the level."""
    out = np.empty(len(y), np.int64)
    for kind in (False, True):  # of one kind at a time: runs of the other side between them touch nothing
        own = np.flatnonzero(dark == kind)
        if len(own):
            out[own] = own[_joined(y[own], a[own], b[own], dark[own].astype(int))]
    return out


def _banded(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["y", "a"], ignore_index=True)
    first = _roots(*(frame[c].to_numpy() for c in ("y", "a", "b", "dark")))
    return frame.assign(root=frame["node"].to_numpy()[first]).drop(columns="band")


def _gray(pixels: np.ndarray) -> np.ndarray:
    """gray_pixels of some rows of a packed image."""
    b, g, r = (pixels[:, :, min(i, pixels.shape[2] - 1)].astype(np.int64) for i in range(3))
    return (b * 1868 + g * 9617 + r * 4899 + 8192) // 16384


def _taps(n: int) -> tuple:
    """For each of n places along an axis, the places of its neighbours before and after it, and of those beyond (see raster.taps)."""
    at = np.arange(n)
    near = lambda step: np.where((at + step >= 0) & (at + step < n), at + step, np.where((at - step >= 0) & (at - step < n), at - step, at))
    far = lambda step: np.where((at + 2 * step >= 0) & (at + 2 * step < n), at + 2 * step, np.where((at + step >= 0) & (at + step < n), at, np.where((at - 2 * step >= 0) & (at - 2 * step < n), at - 2 * step, at)))
    return near(-1), near(1), far(-1), far(1)


def _dark(pixels: np.ndarray, y0: int, y1: int, level: int) -> np.ndarray:
    """Which pixels of the rows y0 to y1 - 1 of a packed image are dark after blurring; only rows within two of them are read."""
    low, high = max(0, y0 - 2), min(len(pixels), y1 + 2)
    v = _gray(pixels[low:high])
    before, after, before2, after2 = _taps(v.shape[1])
    v = v * 6 + (v[:, before] + v[:, after]) * 4 + v[:, before2] + v[:, after2]
    before, after, before2, after2 = (t[y0:y1] - low for t in _taps(len(pixels)))
    v = v[y0 - low : y1 - low] * 6 + (v[before] + v[after]) * 4 + v[before2] + v[after2]
    return (v + 128) // 256 <= level


def rooted_runs(images: DataFrame, level: int = 140) -> DataFrame:
    """dark_runs of packed images with node, the number of a run's first pixel, and root, that of the first run it is joined
    with within its band of BAND rows. Images are worked through by bands, where they lie: no pixel becomes a row."""
    band = BAND
    columns = ["y", "a", "b", "dark", "node", "root"]

    def run(frames):
        for frame in frames:
            out, n = [], 0
            for r in frame.itertuples():
                pixels = array_of(r)
                for y0 in range(0, r.height if r.width else 0, band):
                    dark = _dark(pixels, y0, min(y0 + band, r.height), level)
                    begins = np.ones(dark.shape, bool)
                    begins[:, 1:] = dark[:, 1:] != dark[:, :-1]
                    (y, a), b = np.nonzero(begins), np.nonzero(np.roll(begins, -1, axis=1))[1]
                    sides, y = dark[y, a], y + y0
                    node = y * SIDE + a
                    out.append((r.image_id, y, a, b, sides, node, node[_roots(y, a, b, sides)]))
                    n += len(y)
                    if n > MOST_RUNS:
                        yield listed(out)
                        out, n = [], 0
            if out:
                yield listed(out)

    def listed(out: list) -> pd.DataFrame:
        ids = np.repeat(np.array([o[0] for o in out], object), [len(o[1]) for o in out])
        return pd.DataFrame({"image_id": ids, **{c: np.concatenate([o[k + 1] for o in out]) for k, c in enumerate(columns)}})

    kind = dict(images.dtypes)["image_id"]
    return images.mapInPandas(run, f"image_id {kind}, y int, a int, b int, dark boolean, node long, root long")


def parts(runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """runs with part: the number of the first pixel of the connected part that a run belongs to, OUTER for ground that
    reaches the border. Dark runs touch diagonally, too, those of the ground don't. sizes: image_id, height, width.

    Runs of a band of BAND rows of an image are merged in one task; only what touches across bands, and the border, is left
    to rounds of joins, and those links are between parts of bands.
    """
    named = runs.withColumn("node", F.col("y").cast("long") * SIDE + F.col("a")).withColumn("band", F.floor(F.col("y") / BAND))
    kinds = dict(named.dtypes)
    return _whole(settle(named.groupBy("image_id", "band").applyInPandas(_banded, ", ".join([*(f"{c} {kinds[c]}" for c in named.columns if c != "band"), "root long"])), "bands"), sizes)


def _whole(rooted: DataFrame, sizes: DataFrame) -> DataFrame:
    """parts from settled runs that know their node, and the root that they have within their band."""
    lower = rooted.where(F.col("y") % BAND == 0)
    above = rooted.where(F.col("y") % BAND == BAND - 1).select("image_id", (F.col("y") + 1).alias("y"), "dark", F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("root").alias("v"))
    reach = F.col("dark").cast("int")
    touching = lower.join(_merged(above), ["image_id", "y", "dark"]).where((F.col("a") <= F.col("b0") + reach) & (F.col("a0") <= F.col("b") + reach))
    across = settle(touching.select("image_id", F.col("root").alias("u"), "v").distinct(), "links")
    edge = rooted.where("not dark").join(_merged(sizes), "image_id").where("y = 0 or y = height - 1 or a = 0 or b = width - 1")
    outer = edge.select("image_id", F.col("root").alias("u"), F.lit(OUTER).cast("long").alias("v")).distinct()
    if across.take(1):
        found = components(across.union(outer))
    else:
        found = outer.select("image_id", F.col("u").alias("node"), F.col("v").alias("part"))
    return rooted.join(_merged(found.withColumnRenamed("node", "root")), ["image_id", "root"], "left").withColumn("part", F.coalesce("part", "root")).drop("node", "root")


def nested_contours(labelled: DataFrame) -> DataFrame:
    """Contours with a parent: image_id, part (the dark part that is followed), hole, start and outside (numbers of its
    first pixel and of the neighbour that isn't in it).

    Those are the rims of holes, and parts whose first pixel has ground to its left that doesn't reach the border.
    """
    first = labelled.groupBy("image_id", "dark", "part").agg(F.lit(1)).where("part <> -1").select("image_id", "dark", F.floor(F.col("part") / SIDE).cast("int").alias("y"), (F.col("part") % SIDE - 1).cast("int").alias("b"), F.col("part").alias("own"))
    left = labelled.select("image_id", "y", "b", (~F.col("dark")).alias("dark"), F.col("part").alias("left"))
    beside = first.join(_merged(left), ["image_id", "y", "b", "dark"])
    hole = ~F.col("dark")
    return beside.where(hole | (F.col("left") != OUTER)).select("image_id", F.when(hole, F.col("left")).otherwise(F.col("own")).alias("part"), hole.alias("hole"), F.when(hole, F.col("own") - 1).otherwise(F.col("own")).alias("start"), F.when(hole, F.col("own")).otherwise(F.col("own") - 1).alias("outside"))


class Part:
    """A connected part as its runs (y, a, b), first and last column: whether it holds a pixel is looked up in its row."""

    def __init__(self, runs: list):
        self.rows: dict = {}
        for y, a, b in sorted(runs):
            firsts, lasts = self.rows.setdefault(y, ([], []))
            firsts.append(a)
            lasts.append(b)

    def __contains__(self, place: tuple) -> bool:
        firsts, lasts = self.rows.get(place[0], ((), ()))
        at = bisect_right(firsts, place[1]) - 1
        return at >= 0 and place[1] <= lasts[at]


def contour_tree(labelled: DataFrame) -> DataFrame:
    """Every contour of labelled runs (see parts): image_id, contour (the part's number), hole, parent, depth and place.

    A dark part's contour has as its parent the hole that it lies in, a hole's the part around it: whatever lies left of
    its first pixel. The outermost have no parent and depth 0. place counts the contours of one parent from 0 by their
    first pixel. Depths come from pointers that are doubled, so a nest of n levels takes log n rounds, each settled.
    """
    own = labelled.groupBy("image_id", "dark", "part").agg(F.lit(1)).where(F.col("part") != OUTER).select("image_id", "dark", F.col("part").alias("contour"))
    first = own.withColumns({"y": F.floor(F.col("contour") / SIDE).cast("int"), "b": (F.col("contour") % SIDE - 1).cast("int")})
    left = labelled.select("image_id", "y", "b", (~F.col("dark")).alias("dark"), F.col("part").alias("parent"))
    told = first.join(_merged(left), ["image_id", "y", "b", "dark"], "left").select("image_id", "contour", (~F.col("dark")).alias("hole"), F.when(F.col("parent") != OUTER, F.col("parent")).alias("parent"))
    rows = settle(told.withColumns({"above": F.col("parent"), "depth": F.col("parent").isNotNull().cast("int")}), "tree")
    while rows.where("above is not null").take(1):
        upper = rows.select("image_id", F.col("contour").alias("above"), F.col("above").alias("_next"), F.col("depth").alias("_more"))
        open_, done = rows.where("above is not null"), rows.where("above is null")
        moved = open_.join(_merged(upper), ["image_id", "above"]).select("image_id", "contour", "hole", "parent", F.col("_next").alias("above"), (F.col("depth") + F.col("_more")).alias("depth"))
        rows = settle(moved.unionByName(done), "tree")
    place = F.row_number().over(Window.partitionBy("image_id", "parent").orderBy("contour")) - 1
    return rows.drop("above").withColumn("place", place)


def border(part: Part, start: tuple, outside: tuple) -> np.ndarray:
    """Border of a part from start, whose neighbour outside isn't in it, by following neighbours; (x, y) in order."""
    inside = part.__contains__
    step = lambda p, d: (p[0] + AROUND[d % 8][0], p[1] + AROUND[d % 8][1])
    toward = AROUND.index((outside[0] - start[0], outside[1] - start[1]))
    first = next((d for d in range(toward, toward + 8) if inside(step(start, d))), None)
    if first is None:
        return np.array([[start[1], start[0]]])
    last, here, back, out = step(start, first), start, first % 8, []
    while True:
        turn = next(d for d in range(back - 1, back - 9, -1) if inside(step(here, d)))
        out.append((here[1], here[0]))
        there = step(here, turn)
        if there == start and here == last:
            return np.array(out)
        back = (turn + 4) % 8
        here = there


def simplified(points: np.ndarray, share: float = 0.02) -> np.ndarray:
    """Closed polygon whose distance from points is at most share of their length: recursive halving."""
    p = points.astype(float)
    if len(p) < 4:
        return points
    limit = share * np.linalg.norm(p - np.roll(p, -1, axis=0), axis=1).sum()
    a = 0
    for _ in range(3):
        b = a
        a = int(np.argmax(np.linalg.norm(p - p[b], axis=1)))
    p = np.roll(p, -a, axis=0)
    b = (b - a) % len(p)
    ring, keep, todo = np.concatenate([p, p[:1]]), {0, b}, [(0, b), (b, len(p))]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        d, q = ring[j] - ring[i], ring[i + 1 : j] - ring[i]
        far = np.abs(d[0] * q[:, 1] - d[1] * q[:, 0]) / max(np.hypot(*d), 1e-12)
        k = int(np.argmax(far))
        if far[k] > limit:
            keep.add(i + 1 + k)
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    kept = sorted(keep)
    # A corner that lies on the line of its neighbours is none.
    final = [k for n, k in enumerate(kept) if _off_line(p[kept[n - 1]], p[k], p[kept[(n + 1) % len(kept)]], limit)]
    return np.rint(p[final]).astype(int)


def _off_line(a, b, c, limit) -> bool:
    d = c - a
    return abs(d[0] * (b - a)[1] - d[1] * (b - a)[0]) / max(np.hypot(*d), 1e-12) > limit


def _followed(frames):
    """The corners of each contour of a dark part, given by its runs, that has four."""
    for frame in frames:
        out = []
        for r in frame.itertuples():
            own = Part([(p["y"], p["a"], p["b"]) for p in r.runs])
            at = lambda n: (n // SIDE, n % SIDE)
            for c in r.contours:
                corners = simplified(border(own, at(c["start"]), at(c["outside"])))
                if len(corners) == 4:
                    out.append((r.image_id, c["hole"], c["start"], [{"x": float(x), "y": float(y)} for x, y in corners]))
        yield pd.DataFrame(out, columns=["image_id", "hole", "start", "corners"])


def labelled_runs(images: DataFrame, level: int = 140) -> DataFrame:
    """Runs of every image with their connected parts, settled. images are settled first, for they are read twice."""
    return _labelled(settle(images, "images"), level)


def _labelled(images: DataFrame, level: int) -> DataFrame:
    return settle(_whole(settle(rooted_runs(images, level), "bands"), images.select("image_id", "height", "width")), "parts")


def polygons(images: DataFrame, level: int = 140) -> DataFrame:
    """Simplified nested contours with four corners: image_id, square_id (holes first, then parts, each by their first
    pixel), corners. A task holds the runs of one dark part at a time."""
    labelled = _labelled(images, level)
    contours = nested_contours(labelled).groupBy("image_id", "part").agg(F.collect_list(F.struct("hole", "start", "outside")).alias("contours"))
    own = labelled.where("dark").join(_merged(contours.select("image_id", "part")), ["image_id", "part"], "left_semi").groupBy("image_id", "part").agg(F.collect_list(F.struct("y", "a", "b")).alias("runs"))
    found = own.join(_merged(contours), ["image_id", "part"]).select("image_id", "runs", "contours").mapInPandas(_followed, f"image_id string, hole boolean, start long, corners {QUAD}")
    order = Window.partitionBy("image_id").orderBy(F.col("hole").desc(), "start")
    return found.withColumn("square_id", (F.row_number().over(order) - 1).cast("int")).select("image_id", "square_id", "corners")


def refined(patch: np.ndarray, half: int = HALF, rounds: int = 30, least: float = 0.001) -> np.ndarray:
    """How far from the middle of patch the place lies to which gradients stand at right angles; nothing beyond half."""
    return all_refined(patch[None], half, rounds, least)[0]


def all_refined(patches: np.ndarray, half: int = HALF, rounds: int = 30, least: float = 0.001) -> np.ndarray:
    """refined for each of n patches; those that are through are left out of further rounds."""
    g, middle = patches.astype(float), patches.shape[1] // 2
    offset, span = np.arange(-half, half + 1), np.arange(2 * half + 4)
    weight = np.exp(-((offset / half) ** 2))
    weight = weight[:, None] * weight[None, :]
    px, py = np.meshgrid(offset, offset)
    total = lambda values: values.reshape(len(values), -1).sum(axis=1)
    at, lost, going = np.zeros((len(g), 2)), np.zeros(len(g), bool), np.arange(len(g))
    for _ in range(rounds):
        beyond = np.abs(at[going]).max(axis=1) > half if len(going) else np.zeros(0, bool)
        lost[going[beyond]] = True
        going = going[~beyond]
        if not len(going):
            break
        whole = np.floor(at[going])
        (j, i), (b, a) = whole.astype(int).T, (at[going] - whole).T[:, :, None, None]
        low = middle - half - 1
        w = g[going[:, None, None], (i[:, None] + low + span)[:, :, None], (j[:, None] + low + span)[:, None, :]]
        w = (w[:, :-1, :-1] * (1 - b) + w[:, :-1, 1:] * b) * (1 - a) + (w[:, 1:, :-1] * (1 - b) + w[:, 1:, 1:] * b) * a
        gx, gy = (w[:, 1:-1, 2:] - w[:, 1:-1, :-2]) / 2, (w[:, 2:, 1:-1] - w[:, :-2, 1:-1]) / 2
        xx, xy, yy = total(weight * gx * gx), total(weight * gx * gy), total(weight * gy * gy)
        bx, by = total(weight * (gx * gx * px + gx * gy * py)), total(weight * (gx * gy * px + gy * gy * py))
        det = xx * yy - xy * xy
        some = ~(np.abs(det) <= 1e-12 * (xx + yy) ** 2)
        going, det = going[some], det[some]
        move = (np.stack([yy * bx - xy * by, xx * by - xy * bx])[:, some] / det).T
        at[going] += move
        going = going[~(move[:, 0] * move[:, 0] + move[:, 1] * move[:, 1] < least**2)]
    return np.where((lost | ~(np.abs(at).max(axis=1, initial=0) <= half))[:, None], 0.0, at)


def refined_corners(squares: DataFrame, images: DataFrame) -> DataFrame:
    """squares (image_id, square_id, corners at whole pixels) with corners moved to where edges cross.

    The corners of an image meet it where it lies packed, and only the pixels about them are taken out; beyond the image its
    border goes on.
    """
    kind = dict(squares.dtypes)["image_id"]
    asked = squares.groupBy("image_id").agg(F.collect_list(F.struct("square_id", "corners")).alias("squares"))
    reach = np.arange(-REACH, REACH + 1)

    def run(frames):
        for frame in frames:
            rows = [(r, s["square_id"], np.array([(p["x"], p["y"]) for p in s["corners"]])) for r in frame.itertuples() for s in r.squares]
            for k in range(0, len(rows), SOME_SQUARES):
                some = rows[k : k + SOME_SQUARES]
                at = np.concatenate([c for _, _, c in some])
                patches = np.concatenate([_patches(array_of(r), c.astype(int), reach) for r, _, c in some])
                moved = np.split(np.float32(all_refined(patches) + at), np.cumsum([len(c) for _, _, c in some])[:-1])
                yield pd.DataFrame({"image_id": [r.image_id for r, _, _ in some], "square_id": [n for _, n, _ in some], "corners": [[{"x": float(x), "y": float(y)} for x, y in m] for m in moved]})

    return images.join(_merged(asked), "image_id").mapInPandas(run, f"image_id {kind}, square_id int, corners {QUAD}")


def _patches(pixels: np.ndarray, corners: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The gray values about each corner (x, y) of a packed image."""
    height, width, channels = pixels.shape
    y, x = np.clip(corners[:, 1:] + reach, 0, height - 1), np.clip(corners[:, :1] + reach, 0, width - 1)
    found = pixels[y[:, :, None], x[:, None, :]]
    return _gray(found.reshape(-1, len(reach), channels)).reshape(len(corners), len(reach), len(reach))


def squares(images: DataFrame, min_area: float = 2000, level: int = 140) -> DataFrame:
    """Squares of each image: convex, larger than min_area, not too long; corners in order, then refined on the gray image."""
    q = F.col("corners")
    images = settle(images, "images")  # read three times
    found = polygons(images, level).where(quads.is_convex(q) & (quads.area(q) > min_area) & quads.aspect(q).between(0.6, 3))
    return refined_corners(found.withColumn("corners", quads.sort_corners(q)), images)
