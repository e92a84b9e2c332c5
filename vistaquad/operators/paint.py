"""Painting on pixel relations: discs, rings, segments and outlines as generated pixels, in an order.

A mark is a row (keys, y, x, z, one value for each channel); where several fall on one pixel the largest z stands, settled
by an aggregate that Spark combines before its exchange. Marks are generated from shapes, clipped to the canvas, and joined
with the pixels; no pixel is compared with a shape.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, blue first: real points, projected points, lines of the left and right side, corners; radii and widths.
GREEN, RED, BLUE, ORANGE = [0, 255, 0], [0, 0, 255], [255, 0, 0], [0, 165, 255]
REAL_RADIUS, PROJECTED_RADIUS, LINE_WIDTH, CORNER_RADIUS = 10, 8, 3, 8


def _around(inside) -> Column:
    """Offsets (i down, j right) as an array of structs."""
    return F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in inside))


def _offsets(low: float, high: float) -> list:
    n = int(high)
    return [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1) if low <= i * i + j * j <= high * high]


def _marks(rows: DataFrame, by: tuple, offsets: list, size: tuple, color: list, channels: list) -> DataFrame:
    """rows (by, _y, _x, z) and the pixels about them that lie on the canvas."""
    spread = rows.select(*by, "_y", "_x", "z", F.explode(_around(offsets)).alias("_o"))
    placed = spread.select(*by, (F.col("_y") + F.col("_o.i")).cast("int").alias("y"), (F.col("_x") + F.col("_o.j")).cast("int").alias("x"), "z", *(F.lit(v).alias(c) for c, v in zip(channels, color, strict=True)))
    return placed.where((F.col("y") >= 0) & (F.col("y") < size[0]) & (F.col("x") >= 0) & (F.col("x") < size[1]))


def discs(points: DataFrame, radius: int, size: tuple, color: list, channels: list, by: tuple = ("image_id",)) -> DataFrame:
    """Marks of filled circles about points (by, y, x, z); size: height and width of the canvas."""
    near = points.where(F.col("y").between(-radius, size[0] + radius) & F.col("x").between(-radius, size[1] + radius))
    return _marks(near.select(*by, F.col("y").alias("_y"), F.col("x").alias("_x"), "z"), by, _offsets(0, radius), size, color, channels)


def rings(points: DataFrame, radius: int, width: int, size: tuple, color: list, channels: list, by: tuple = ("image_id",)) -> DataFrame:
    """Marks of circle outlines `width` pixels wide about points (by, y, x, z)."""
    reach = radius + width
    near = points.where(F.col("y").between(-reach, size[0] + reach) & F.col("x").between(-reach, size[1] + reach))
    low, high = max(0.0, radius - width / 2), radius + width / 2
    return _marks(near.select(*by, F.col("y").alias("_y"), F.col("x").alias("_x"), "z"), by, _offsets(low * low, high), size, color, channels)


def segments(lines: DataFrame, width: int, size: tuple, color: list, channels: list, by: tuple = ("image_id",)) -> DataFrame:
    """Marks of straight lines (by, y0, x0, y1, x1, z; whole numbers), `width` pixels wide, both ends included.

    A line has a step for each pixel of its longer axis; the other axis is rounded to the nearest. Only steps that can lie
    on the canvas are generated, so a line that leaves it far behind costs no more than the canvas is wide.
    """
    n = F.greatest(F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("x1") - F.col("x0")), F.lit(1).cast("long"))
    rows = lines.select(*by, *(F.col(c).cast("long").alias(c) for c in ("y0", "x0", "y1", "x1")), "z").withColumn("_n", n)
    low, high = [F.lit(0.0)], [F.col("_n").cast("double")]
    for axis, most in (("y", size[0]), ("x", size[1])):
        step = (F.col(f"{axis}1") - F.col(f"{axis}0")) / F.col("_n")
        ends = [(F.lit(float(edge)) - F.col(f"{axis}0")) / F.nullif(step, F.lit(0.0)) for edge in (-width, most + width)]
        outside = (step == 0) & ~F.col(f"{axis}0").between(-width, most + width)
        low.append(F.when(outside, F.lit(1e18)).otherwise(F.coalesce(F.least(*ends), F.lit(0.0))))
        high.append(F.when(outside, F.lit(-1.0)).otherwise(F.coalesce(F.greatest(*ends), F.lit(1e18))))
    first, last = F.floor(F.greatest(*low) - 1), F.ceil(F.least(*high) + 1)
    first, last = F.greatest(first, F.lit(0).cast("long")), F.least(last, F.col("_n"))
    steps = rows.withColumns({"_f": first, "_l": last}).where("_f <= _l").withColumn("_k", F.explode(F.sequence("_f", "_l")))
    at = lambda axis: F.col(f"{axis}0") + F.expr(f"floor((2 * _k * ({axis}1 - {axis}0) + _n) / (2 * _n))")
    return _marks(steps.select(*by, at("y").alias("_y"), at("x").alias("_x"), "z"), by, _offsets(0, width / 2), size, color, channels)


def outlines(quads: DataFrame, width: int, size: tuple, color: list, channels: list, by: tuple = ("image_id",)) -> DataFrame:
    """Marks of the closed outlines of quads (by, corners, z), corners cut to whole pixels."""
    at = lambda k, f: F.get("corners", F.lit(k % 4))[f].cast("long")
    sides = F.array(*(F.struct(at(k, "y").alias("y0"), at(k, "x").alias("x0"), at(k + 1, "y").alias("y1"), at(k + 1, "x").alias("x1")) for k in range(4)))
    return segments(quads.select(*by, "z", F.explode(sides).alias("s")).select(*by, "z", "s.*"), width, size, color, channels, by)


def painted(pixels: DataFrame, marks: list, channels: list, by: tuple = ("image_id",)) -> DataFrame:
    """pixels with the marks on them. Marks beyond the pixels are left out; of equal z the largest colour stands."""
    keys = [*by, "y", "x"]
    top = reduce(DataFrame.unionByName, marks).groupBy(*keys).agg(F.max(F.struct("z", *channels)).alias("_top"))
    joined = pixels.join(top, keys, "left")
    return joined.withColumns({c: F.when(F.col("_top").isNotNull(), F.col("_top")[c]).otherwise(F.col(c)) for c in channels}).drop("_top")


def draw_reprojections(pixels: DataFrame, notes: DataFrame, size: tuple, channels: list, by: tuple = ("image_id",), radii: tuple = (REAL_RADIUS, PROJECTED_RADIUS), width: int = LINE_WIDTH, colors: tuple = (GREEN, RED, BLUE, ORANGE)) -> DataFrame:
    """Real and projected places of notes (by, side, idx, real_x, real_y, proj_x, proj_y; see report.annotations) as discs,
    and the line between them, side "L" before "R" and each in the order of idx; what comes later lies on top.

    Nulls in a note leave out what they belong to. Labels and errors stay rows of notes.
    """
    right = F.col("side") == "R"
    rows = notes.withColumn("_order", F.struct(right.alias("right"), F.col("idx").cast("long").alias("idx")))
    z = lambda k: F.struct("_order", F.lit(k).alias("part")).alias("z")
    place = lambda name, k: rows.where(f"{name}_x is not null and {name}_y is not null").select(*by, F.col(f"{name}_y").alias("y"), F.col(f"{name}_x").alias("x"), z(k))
    whole = rows.where(" and ".join(f"{n}_{a} is not null" for n in ("real", "proj") for a in "xy"))
    lines = whole.select(*by, "side", F.col("real_y").alias("y0"), F.col("real_x").alias("x0"), F.col("proj_y").alias("y1"), F.col("proj_x").alias("x1"), z(2))
    marks = [discs(place("real", 0), radii[0], size, colors[0], channels, by), discs(place("proj", 1), radii[1], size, colors[1], channels, by)]
    marks += [segments(lines.where(on), width, size, color, channels, by) for on, color in ((F.col("side") != "R", colors[2]), (F.col("side") == "R", colors[3]))]
    return painted(pixels, marks, channels, by)


def detection_picture(pixels: DataFrame, squares: DataFrame, size: tuple, channels: list) -> DataFrame:
    """Detected squares (image_id, square_id, corners): green outlines, and a blue disc on each corner."""
    z = lambda k: F.struct("square_id", F.lit(k).alias("part")).alias("z")
    corners = squares.select("image_id", "square_id", F.explode("corners").alias("p")).select("image_id", F.col("p.y").cast("long").alias("y"), F.col("p.x").cast("long").alias("x"), z(1))
    return painted(pixels, [outlines(squares.select("image_id", "corners", z(0)), LINE_WIDTH, size, GREEN, channels), discs(corners, CORNER_RADIUS, size, BLUE, channels)], channels)
