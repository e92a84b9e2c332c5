"""Detection against a version that works on whole images, one at a time."""

import numpy as np
import pytest
from plain import blurred

from vistaquad.operators import detect
from vistaquad.operators.detect import Part, border
from vistaquad.sources import schema
from vistaquad.sources.images import row_of


def labels(mask: np.ndarray, diagonal: bool) -> np.ndarray:
    """A number for each connected part of mask, 0 outside: runs of a row are joined with touching runs above."""
    parent = [0]

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out, above, reach = np.zeros(mask.shape, np.int32), [], int(diagonal)
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        runs, k = [], 0
        for a, b in edge.reshape(-1, 2):
            while k < len(above) and above[k][1] + reach <= a:
                k += 1
            name, j = 0, k
            while j < len(above) and above[j][0] < b + reach:
                other = root(above[j][2])
                if not name:
                    name = other
                elif other != name:
                    low, high = min(name, other), max(name, other)
                    parent[high] = name = low
                j += 1
            if not name:
                name = len(parent)
                parent.append(name)
            out[y, a:b] = name
            runs.append((a, b, name))
        above = runs
    return np.array([root(i) for i in range(len(parent))], np.int32)[out]


def runs_of(mask: np.ndarray) -> list:
    edges = [np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]]))).reshape(-1, 2) for row in mask]
    return [(y, int(a), int(b) - 1) for y, row in enumerate(edges) for a, b in row]


def nested_borders(mask: np.ndarray) -> list:
    """Borders with a parent: of holes, along the pixels around them, and of parts that lie inside holes."""
    part, held = labels(mask, True), Part(runs_of(mask))
    framed = np.pad(~mask, 1, constant_values=True)
    ground = labels(framed, False)
    outer = ground[0, 0]
    out = []
    for which, kinds in ((ground, "hole"), (part, "part")):
        names, places = np.unique(which, return_index=True)
        for name, at in zip(names, places, strict=True):
            y, x = divmod(int(at), which.shape[1])
            if name == 0 or (kinds == "hole" and name == outer):
                continue
            if kinds == "hole":  # first pixel of the hole; the one to its left is the mask's
                out.append(border(held, (y - 1, x - 2), (y - 1, x - 1)))
            elif ground[y + 1, x] != outer:
                out.append(border(held, (y, x), (y, x - 1)))
    return out


def plain(gray: np.ndarray, level: int = 140) -> list:
    dark = np.floor(blurred(gray.astype(float)) + 0.5) <= level
    found = [detect.simplified(line) for line in nested_borders(dark)]
    return sorted(sorted(map(tuple, c.tolist())) for c in found if len(c) == 4)


def pictures() -> list:
    rng = np.random.default_rng(12)
    out = []
    for k in range(6):
        a = np.full((70 + k, 90), 30, np.uint8)
        a[5:60, 4:80] = 235
        for _ in range(4):
            y, x, n = rng.integers(8, 40), rng.integers(8, 60), rng.integers(6, 16)
            a[y : y + n, x : x + n] = rng.choice([20, 30])
            a[y + 2 : y + n - 3, x + 2 : x + n - 3] = rng.choice([20, 240])
        out.append(a)
    noise = rng.integers(0, 255, (40, 50)).astype(np.uint8)
    blocks = np.kron(rng.choice([10, 240], (12, 14)), np.ones((7, 7))).astype(np.uint8)
    return [*out, noise, blocks, np.full((9, 9), 250, np.uint8), np.zeros((5, 7), np.uint8)]


def test_polygons_equal_the_plain_version(spark):
    shots = pictures()
    images = spark.createDataFrame([row_of(f"i{k}", a) for k, a in enumerate(shots)], schema.IMAGES)
    found: dict = {}
    for r in detect.polygons(images).collect():
        found.setdefault(r.image_id, []).append(sorted((int(p.x), int(p.y)) for p in r.corners))
    want = {f"i{k}": plain(a) for k, a in enumerate(shots)}
    assert {k: sorted(v) for k, v in found.items()} == {k: v for k, v in want.items() if v} and sum(map(len, want.values())) > 8


def plain_tree(mask: np.ndarray) -> dict:
    """{(first pixel, hole): (parent's first pixel, depth, place)}: parts and holes by flood, parents by what is left of them."""
    dark, framed = labels(mask, True), labels(np.pad(~mask, 1, constant_values=True), False)
    ground = framed[1:-1, 1:-1]
    name = lambda y, x: None if x < 0 or ground[y, x] == framed[0, 0] else ("d", dark[y, x]) if mask[y, x] else ("g", ground[y, x])
    firsts: dict = {}
    for y, x in np.ndindex(mask.shape):
        if name(y, x) is not None:
            firsts.setdefault(name(y, x), (y, x))
    parents = {n: name(y, x - 1) for n, (y, x) in firsts.items()}
    number = lambda n: None if n is None else firsts[n][0] * detect.SIDE + firsts[n][1]
    out, children = {}, {}
    for n in sorted(firsts, key=number):
        depth, p = 0, parents[n]
        while p is not None:
            depth, p = depth + 1, parents[p]
        place = children[parents[n]] = children.get(parents[n], -1) + 1
        out[number(n), n[0] == "g"] = (number(parents[n]), depth, place)
    return out


def test_parts_across_bands(spark, monkeypatch):
    """Bands of any height give the same parts as whole images."""
    rng = np.random.default_rng(8)
    shots = [*pictures()[-4:], np.kron(rng.choice([10, 240], (20, 9)), np.ones((5, 5))).astype(np.uint8), np.kron(rng.choice([10, 240], (30, 30)), np.ones((2, 2))).astype(np.uint8)]
    images = spark.createDataFrame([row_of(f"i{k}", a) for k, a in enumerate(shots)], schema.IMAGES)
    runs, sizes = detect.dark_runs(detect.gray_pixels(images)).cache(), images.select("image_id", "height", "width")
    seen = []
    for band in (1, 2, 7, 64):
        monkeypatch.setattr(detect, "BAND", band)
        seen.append(sorted(map(tuple, detect.parts(runs, sizes).select("image_id", "y", "a", "b", "dark", "part").collect())))
    assert all(s == seen[0] for s in seen)
    for k, a in enumerate(shots):
        dark = np.floor(blurred(a.astype(float)) + 0.5) <= 140
        part = labels(dark, True)
        for name in np.unique(part[part > 0]):
            y, x = map(int, np.argwhere(part == name)[0])
            got = {(r[1], r[2], r[3]) for r in seen[0] if r[0] == f"i{k}" and r[4] and r[5] == y * detect.SIDE + x}
            assert got == set(runs_of(part == name))


def test_contour_tree_equals_the_plain_nest(spark):
    """Squares in squares seven levels deep with several on a level, and noise: parent, depth and order of each contour."""
    nest = np.full((64, 64), 250, np.uint8)
    for level in range(7):
        nest[4 * level + 2 : 62 - 4 * level, 4 * level + 2 : 62 - 4 * level] = 20 if level % 2 == 0 else 250
    wide = np.full((50, 90), 240, np.uint8)
    wide[3:47, 3:87] = 20
    for k in range(4):
        wide[8:42, 8 + 20 * k : 22 + 20 * k] = 240
        wide[14 : 20 + 5 * k, 11 + 20 * k : 19 + 20 * k] = 20
    shots = [*pictures(), nest, wide]
    images = spark.createDataFrame([row_of(f"i{k}", a) for k, a in enumerate(shots)], schema.IMAGES)
    got: dict = {}
    for r in detect.contour_tree(detect.labelled_runs(images)).collect():
        got.setdefault(r.image_id, {})[r.contour, r.hole] = (r.parent, r.depth, r.place)
    want = {f"i{k}": plain_tree(np.floor(blurred(a.astype(float)) + 0.5) <= 140) for k, a in enumerate(shots)}
    assert got == {k: v for k, v in want.items() if v}
    assert max(d for v in want.values() for _, d, _ in v.values()) >= 5


def test_corners_are_found_between_pixels(spark):
    """A square whose edges lie at fractions of pixels, drawn by how much of each pixel it covers."""
    left, top, size = 20.3, 15.7, 40.0
    cover = lambda n, lo: np.clip(np.minimum(np.arange(n) + 1, lo + size) - np.maximum(np.arange(n), lo), 0, 1)
    a = 240 - 220 * cover(80, top)[:, None] * cover(90, left)[None, :]
    a[:4], a[-4:], a[:, :4], a[:, -4:] = 20, 20, 20, 20
    found = detect.squares(spark.createDataFrame([row_of("i", np.rint(a).astype(np.uint8))], schema.IMAGES), 500).collect()
    want = np.array([(left, top), (left + size, top), (left + size, top + size), (left, top + size)]) - 0.5
    assert any(np.abs(np.array([(p.x, p.y) for p in r.corners]) - want).max() < 0.6 for r in found)


def test_components_of_long_chains(spark):
    rows = [("i", n, n - 1) for n in range(1, 60)] + [("i", 100, 90), ("j", 5, 2), ("j", 9, 5), ("j", 9, 2)]
    got = {(r.image_id, r.node): r.part for r in detect.components(spark.createDataFrame(rows, "image_id string, u long, v long")).collect()}
    assert got == {**{("i", n): 0 for n in range(1, 60)}, ("i", 100): 90, ("j", 5): 2, ("j", 9): 2}


@pytest.mark.parametrize("shift", [0, 3])
def test_refinement_stays_near(shift):
    side = 2 * detect.REACH + 1
    patch = np.full((side, side), 200)
    patch[side // 2 + shift :, side // 2 + shift :] = 20
    assert np.abs(detect.refined(patch) - (shift - 0.5)).max() < 0.3
    assert not detect.refined(np.full((side, side), 7)).any()


def _broadcasts(spark, run):
    """Rows of run(), and how many of the plans that Spark executed meanwhile have a broadcast."""
    seen, status = [], spark._jsparkSession.sharedState().statusStore()
    before = status.executionsCount()
    rows = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    for i in range(before, status.executionsCount()):
        seen.append(status.executionsList(i, 1).head().physicalPlanDescription())
    return rows, sum("BroadcastExchange" in plan for plan in seen)


@pytest.mark.parametrize("name", ["q33_detect", "q55_contour_tree"])
def test_nothing_that_grows_with_images_is_broadcast(spark, tmp_path, name):
    from vistaquad.plans.registry import QUERIES

    spark.range(6).selectExpr("id as s_suppkey").write.parquet(str(tmp_path / "supplier.parquet"))
    rows, broadcasts = _broadcasts(spark, lambda: QUERIES[name](spark, str(tmp_path)).collect())
    assert len(rows) == {"q33_detect": 6 * 8, "q55_contour_tree": 6 * 3}[name]
    assert broadcasts == 0


def test_runs_of_packed_images_equal_those_of_pixels(spark, monkeypatch):
    """Bands of packed images give the runs and parts that windows over pixels give; images of three channels and tiny ones, too."""
    rng = np.random.default_rng(21)
    shots = [*pictures()[-4:], rng.integers(0, 255, (23, 31, 3)).astype(np.uint8), *(rng.integers(0, 255, (h, w)).astype(np.uint8) for h, w in ((1, 1), (1, 4), (2, 3), (3, 2), (5, 1)))]
    images = spark.createDataFrame([row_of(f"i{k}", a) for k, a in enumerate(shots)], schema.IMAGES).cache()
    named = ["image_id", "y", "a", "b", "dark"]
    want = sorted(map(tuple, detect.dark_runs(detect.gray_pixels(images)).select(*named).collect()))
    for band in (3, 64):
        monkeypatch.setattr(detect, "BAND", band)
        rooted = detect.rooted_runs(images)
        assert sorted(map(tuple, rooted.select(*named).collect())) == want
        assert "Exchange" not in rooted._jdf.queryExecution().toString()
        parts = detect.parts(detect.dark_runs(detect.gray_pixels(images)), images.select("image_id", "height", "width")).select(*named, "part").collect()
        assert sorted(map(tuple, detect.labelled_runs(images).select(*named, "part").collect())) == sorted(map(tuple, parts))


def test_corners_refined_together():
    """Each of many patches goes as far as it goes alone, and their pixels beyond the image are those of its border."""
    rng = np.random.default_rng(22)
    shot = np.kron(rng.choice([10, 240], (5, 6)), np.ones((9, 9))).astype(np.uint8)[:, :, None]
    corners, reach = np.stack([rng.integers(0, 54, 40), rng.integers(0, 45, 40)], 1), np.arange(-detect.REACH, detect.REACH + 1)
    patches = detect._patches(shot, corners, reach)
    padded = np.pad(shot[:, :, 0], detect.REACH, mode="edge")
    assert all((p == padded[y : y + len(reach), x : x + len(reach)]).all() for p, (x, y) in zip(patches, corners, strict=True))
    together = detect.all_refined(patches)
    assert (together == np.array([detect.refined(p) for p in patches])).all() and (together != 0).any()


def test_pixels_of_pictures_are_packed_where_they_are_made(spark, tmp_path):
    """Pictures are dealt out as suppliers, not as pixels, over more than one task."""
    from vistaquad.plans import standins
    from vistaquad.sources.images import pack

    spark.range(40).selectExpr("id as s_suppkey").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    packed = pack(standins.pictures(spark, str(tmp_path)), ["v"])
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert packed.count() == 40 and standins.pictures(spark, str(tmp_path)).rdd.getNumPartitions() > 1
