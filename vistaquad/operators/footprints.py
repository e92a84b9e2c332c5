"""Views of any number of cameras: which overlap, found by a join over grid cells, and all of them merged in one pass.

A footprint is the quad that an image's corners make under its homography, cut to the canvas by cells only. Views that
share a cell are candidates, judged in the first they share; the separating axes of two convex quads decide. No pair is
named and none is compared that shares no cell.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import project
from vistaquad.operators.raster import non_black
from vistaquad.sources.shared import settle

CELL = 64  # pixels of a grid cell's side
LEAST_BLOCKS, PER_BLOCK = 4, 16_384  # that those of a cell are dealt into, at least; views, about, for each beyond that
SLACK = 1.0  # pixels by which boxes may be apart and still be judged by their sides: what touches is told by those alone


def footprints(images: DataFrame, homographies: DataFrame) -> DataFrame:
    """camera_id and corners (four structs x, y): where the corners of each image (image_id, height, width) lie under the h
    of its camera. Cameras without h, and those whose horizon crosses the image, have none."""
    rows = images.select(F.col("image_id").alias("camera_id"), "height", "width").join(homographies.where("h is not null").select("camera_id", "h"), "camera_id")
    places = [(x, y) for y in (F.lit(0.0), F.col("height") - 1.0) for x in (F.lit(0.0), F.col("width") - 1.0)]
    places = [places[i] for i in (0, 1, 3, 2)]
    w = [F.col("h.h20") * x + F.col("h.h21") * y + F.col("h.h22") for x, y in places]
    corners = F.array(*(F.struct(u.alias("x"), v.alias("y")) for u, v in (project(F.col("h"), x, y) for x, y in places)))
    return rows.where((F.least(*w) > 0) | (F.greatest(*w) < 0)).select("camera_id", corners.alias("corners"))


XY = [f"{f}{k}" for k in range(4) for f in "xy"]  # a quad as plain columns

# Formulas are SQL text below: one expression for Spark to take, not hundreds of calls, and small enough to be compiled.


def _listed(function: str, items) -> str:
    return f"{function}({', '.join(items)})"


def _along(k: int, side: str = "", quad: str = "") -> list:
    """Where the corners of a quad lie along the normal of side k; side and quad are what column names end in."""
    return [f"x{i}{quad} * nx{k}{side} + y{i}{quad} * ny{k}{side}" for i in range(4)]


def _beyond(one: str, other: str) -> str:
    """Whether a side of quad one has all of the other strictly beyond it, or all of it strictly behind quad one."""
    return " or ".join(f"hi{k}{one} < {_listed('least', _along(k, one, other))} or {_listed('greatest', _along(k, one, other))} < lo{k}{one}" for k in range(4))


def _sided(views: DataFrame, keys: list, end: str) -> DataFrame:
    """views with the normal (nx, ny) of each side, how far the quad itself reaches along it (lo, hi) and its box; names,
    but for those of keys, have end. Worked out once for each view, not for each pair."""
    there = [f"coalesce({c}, 0D) as {c}" for c in XY]  # none is null, but Spark can't know it
    normals = [n for k in range(4) for n in (f"y{(k + 1) % 4} - y{k} as nx{k}", f"x{k} - x{(k + 1) % 4} as ny{k}")]
    reach = [f"{_listed(f, _along(k))} as {n}{k}" for k in range(4) for n, f in (("lo", "least"), ("hi", "greatest"))]
    box = [f"{_listed(f, [f'{c}{k}' for k in range(4)])} {more} as {c}_{n}" for c in "xy" for n, f, more in (("min", "least", ""), ("max", "greatest", f"+ {SLACK}D"))]
    kept = [c for c in views.columns if c not in XY]
    rows = views.selectExpr(*kept, *there).selectExpr("*", *normals).selectExpr("*", *reach, *box)
    return rows.toDF(*(c if c in keys else c + end for c in rows.columns))


def overlapping(quads: DataFrame, width: int, height: int, cell: int = CELL) -> DataFrame:
    """first and second (camera_id, the smaller first) of every two footprints that touch or overlap, on the canvas at least
    by their bounding boxes. quads: camera_id, corners (convex). One row for each pair; nulls and quads off the canvas have none.

    Each pair meets in one place, the first cell that both have: either it is the first of one of them, its home, or it is
    in the first row of cells of one and in the first column of the other. Those at home in a cell, and those in its first
    column, are dealt into blocks, and the others of the cell are sent to each block: a full cell is spread over tasks.
    """
    spark = quads.sparkSession
    flat = quads.where("corners is not null").selectExpr("camera_id", *(f"cast(get(corners, {k}).{f} as double) as {f}{k}" for k in range(4) for f in "xy"))
    views = settle(flat, "views").dropna()  # else the corners are worked out anew wherever one is named
    ends = {f"{n}_{c}": _listed(f, [f"{c}{k}" for k in range(4)]) for c in "yx" for n, f in (("low", "least"), ("high", "greatest"))}
    shown = views.where(f"{ends['high_x']} >= 0 and {ends['low_x']} <= {width - 1} and {ends['high_y']} >= 0 and {ends['low_y']} <= {height - 1}")
    total, most = shown.groupBy("camera_id").count().selectExpr("coalesce(sum(count), 0)", "coalesce(max(count), 0)").first()
    blocks = max(LEAST_BLOCKS, total // PER_BLOCK)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    last = {"y": (height - 1) // cell, "x": (width - 1) // cell}
    celled = [f"cast(least(greatest(floor({e} / {cell}), 0), {last[n[-1]]}) as int) as {n}" for n, e in ends.items()]
    cells = shown.selectExpr("*", *celled).selectExpr("*", "explode(sequence(low_y, high_y)) as cy").selectExpr("*", "explode(sequence(low_x, high_x)) as cx", "cy = low_y as top")
    cells = cells.selectExpr("cy", "cx", "top", "cx = low_x as left", "camera_id", *XY)
    key = ["cy", "cx", "home", "block"]
    dealt = cells.where("left").selectExpr("cy", "cx", "top as home", f"cast(pmod(xxhash64(camera_id), {blocks}) as int) as block", "camera_id", *XY)
    met = "explode(if(top and not left, array(true, false), array(true))) as home"  # those at home, and those in the first column
    sent = cells.selectExpr("cy", "cx", met, "camera_id", *XY, "top and left as both").selectExpr("*", f"explode(sequence(0, {blocks - 1})) as block")
    one, two = (_sided(rows.repartition(parts, *key), key, end) for rows, end in ((sent, "_1"), (dealt, "_2")))
    near = " and ".join(f"{c}_min{a} <= {c}_max{b}" for c in "xy" for a, b in (("_1", "_2"), ("_2", "_1")))
    once = "(camera_id_1 < camera_id_2 or (not both_1 and camera_id_1 <> camera_id_2))"
    found = one.join(two.hint("merge"), key).where(f"{once} and {near} and not ({_beyond('_1', '_2')}) and not ({_beyond('_2', '_1')})")
    found = found.selectExpr("least(camera_id_1, camera_id_2) as first", "greatest(camera_id_1, camera_id_2) as second")
    return found.distinct() if most > 1 else found


def mosaic(pixels: DataFrame, channels: list, by: tuple = (), level: int = 10) -> DataFrame:
    """by, y, x and channels of all views laid over each other: of the views (pixels: by, pos, y, x, channels) that are lit
    above level at a place, the one of the least pos is taken; cropped to what is lit, black where no view is.

    One aggregation by place, combined before the exchange, however many views there are; a box that is not filled is
    completed from generated rows. Groups without a lit pixel have no rows.
    """
    keys = [*by, "y", "x"]
    lit = pixels.where(non_black(channels, level))
    top = lit.groupBy(*keys).agg(F.min(F.struct("pos", *channels)).alias("_top")).select(*keys, *(F.col("_top")[c].alias(c) for c in channels))
    box = lit.groupBy(*by).agg(*(f(c).alias(f"_{c}{n}") for c in "yx" for f, n in ((F.min, 0), (F.max, 1)))).where("_y0 is not null")
    filled = box.select(*by, "_y0", "_x0", "_x1", F.explode(F.sequence("_y0", "_y1")).alias("y")).select(*by, "_y0", "_x0", "y", F.explode(F.sequence("_x0", "_x1")).alias("x"))
    found = filled.join(top, keys, "left")
    return found.select(*by, (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"), *(F.coalesce(c, F.lit(0)).alias(c) for c in channels))
