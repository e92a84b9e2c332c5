"""Quads (arrays of four structs x, y) as column expressions; no join, no shuffle, no Python on executors."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from vistaquad.functions.geometry import distance, project


def bound(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often then names it; Spark shares nothing inside lambdas."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def centroid(quad: Column) -> tuple[Column, Column]:
    total = lambda f: F.aggregate(quad, F.lit(0.0), lambda a, p: a + p[f]) / 4
    return total("x"), total("y")


def sort_corners(quad: Column) -> Column:
    """Top left, top right, bottom right, bottom left: two by two about the mean x; else by angle about the centroid."""

    def keyed(q: Column) -> Column:
        return bound(F.struct(*(m.alias(n) for n, m in zip("xy", centroid(q), strict=True))), lambda m: F.transform(q, lambda p, k: F.struct((p["x"] < m["x"]).alias("left"), p["y"].alias("y"), k.alias("k"), p["x"].alias("x"), F.atan2(p["y"] - m["y"], p["x"] - m["x"]).alias("a"))))

    def side(rows: Column, left: bool) -> Column:
        own = F.filter(rows, lambda p: p["left"] if left else ~p["left"])
        return F.array_sort(F.transform(own, lambda p: F.struct(p["y"].alias("y"), p["k"].alias("k"), p["x"].alias("x"))))

    def ordered(rows: Column) -> Column:
        pick = lambda a, i: _point(F.get(a, F.lit(i))["x"], F.get(a, F.lit(i))["y"])
        square = lambda s: F.array(pick(s["l"], 0), pick(s["r"], 0), pick(s["r"], 1), pick(s["l"], 1))
        around = F.array_sort(F.transform(rows, lambda p: F.struct(p["a"].alias("a"), p["k"].alias("k"), p["x"].alias("x"), p["y"].alias("y"))))
        sides = F.struct(side(rows, True).alias("l"), side(rows, False).alias("r"))
        return bound(sides, lambda s: F.when(F.size(s["l"]) == 2, square(s)).otherwise(F.transform(around, lambda p: _point(p["x"], p["y"]))))

    return bound(quad, lambda q: bound(keyed(q), ordered))


def normalize(quad: Column) -> Column:
    """From the vertex of least y, then x, moved to the origin and turned so that the next one lies on the x axis."""

    def rolled(q: Column) -> Column:
        start = F.array_min(F.transform(q, lambda p, k: F.struct(p["y"].alias("y"), p["x"].alias("x"), k.alias("k"))))["k"]
        return bound(start, lambda k: F.concat(F.slice(q, k + 1, 4 - k), F.slice(q, F.lit(1), k)))

    def turned(r: Column) -> Column:
        first, second = F.get(r, F.lit(0)), F.get(r, F.lit(1))
        turn = -F.atan2(second["y"] - first["y"], second["x"] - first["x"])
        frame = F.struct(first["x"].alias("x"), first["y"].alias("y"), F.cos(turn).alias("c"), F.sin(turn).alias("s"))
        return bound(frame, lambda f: F.transform(r, lambda p: _point((p["x"] - f["x"]) * f["c"] - (p["y"] - f["y"]) * f["s"], (p["x"] - f["x"]) * f["s"] + (p["y"] - f["y"]) * f["c"])))

    return bound(quad, lambda q: bound(rolled(q), turned))


def project_quad(h: Column, quad: Column) -> Column:
    return F.transform(quad, lambda p: _point(*project(h, p["x"], p["y"], "cv")))


def metric(quad: Column, size: float = 100, compat: bool = True) -> Column:
    """How far a projected quad is from a square of the given size.

    compat compares vertices 0, 1 and 2 with (0, s), (s, s) and (s, 0), so a perfect square gives 3 s. Otherwise
    vertices 1, 2 and 3 are compared with (s, 0), (s, s) and (0, s), and a perfect square gives 0.
    """
    s, zero = F.lit(float(size)), F.lit(0.0)
    targets = [(1, s, s), (2, s, zero), (0, zero, s)] if compat else [(1, s, zero), (2, s, s), (3, zero, s)]

    def apart(n: Column) -> Column:
        one, two, three = (distance(F.get(n, F.lit(i))["x"], F.get(n, F.lit(i))["y"], x, y) for i, x, y in targets)
        return one + two + three

    return bound(normalize(quad), apart)


def area(quad: Column) -> Column:
    """Unsigned shoelace area."""
    at = lambda i, f: F.get(quad, F.lit(i % 4))[f]
    return F.abs(sum((at(i, "x") * at(i + 1, "y") - at(i + 1, "x") * at(i, "y") for i in range(1, 4)), at(0, "x") * at(1, "y") - at(1, "x") * at(0, "y"))) / 2


def is_convex(quad: Column) -> Column:
    at = lambda i, f: F.get(quad, F.lit(i % 4))[f]
    turn = [(at(i + 1, "x") - at(i, "x")) * (at(i + 2, "y") - at(i + 1, "y")) - (at(i + 1, "y") - at(i, "y")) * (at(i + 2, "x") - at(i + 1, "x")) for i in range(4)]
    return (F.least(*turn) >= 0) | (F.greatest(*turn) <= 0)


def aspect(quad: Column) -> Column:
    """Width by height of the bounding box, both counted in whole pixels with their ends."""
    size = lambda f: F.floor(F.array_max(F.transform(quad, lambda p: p[f]))) - F.floor(F.array_min(F.transform(quad, lambda p: p[f]))) + 1
    return size("x").cast("double") / size("y")
