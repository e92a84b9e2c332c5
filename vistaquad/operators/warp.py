"""Warps as a gather over tiles: an index of source tiles with a halo, output tiles mapped back to the tiles they touch.

Pixels are relations (keys, y, x, channels) of bytes. A source tile holds TILE x TILE pixels and, as its halo, the next row
and column, so the four neighbours of any place lie in one tile; black pixels and black tiles aren't stored. An output tile
meets the source tiles that its outline encloses by a join on (image, tile), is dealt out by its own key, and only then
becomes pixels, so neither a large image nor a strongly enlarged tile fills a task.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vistaquad.functions.geometry import ENTRIES, adjugate, similarity_of
from vistaquad.sources.images import explode, pack
from vistaquad.sources.shared import settle

BITS = 6
TILE = 1 << BITS
SIDE = TILE + 1  # with its halo
MARGIN = 1e-6  # by which an outline is widened against rounding


def tile_index(pixels: DataFrame, channels: list, by: tuple = ("image_id",)) -> DataFrame:
    """by, ty, tx and, for each channel, an array of SIDE x SIDE values: each tile that isn't all black.

    Tile (ty, tx) begins at row ty * TILE; tiles of index -1 hold what neighbours of places just outside need. Gaps are
    black; of several rows of one pixel the least counts.
    """

    def placed(axis: str) -> Column:
        own, at = F.floor(F.col(axis) / TILE).cast("int"), F.pmod(F.col(axis), F.lit(TILE)).cast("int")
        one = lambda t, i: F.struct(t.alias("t"), i.alias("i"))
        return F.when(at == 0, F.array(one(own, at), one(own - 1, F.lit(TILE)))).otherwise(F.array(one(own, at)))

    lit = pixels.where(" or ".join(f"{c} <> 0" for c in channels)).select(*by, *(F.col(c).cast("short").alias(c) for c in channels), "x", F.explode(placed("y")).alias("_y"))
    cells = lit.withColumn("_x", F.explode(placed("x")))
    entry = F.struct((F.col("_y.i") * SIDE + F.col("_x.i")).alias("at"), *channels)
    tiles = cells.groupBy(*by, F.col("_y.t").alias("ty"), F.col("_x.t").alias("tx")).agg(F.array_sort(F.collect_set(entry)).alias("entries"))  # SIDE * SIDE at most
    first = F.filter("entries", lambda e, i: (i == 0) | (e["at"] != F.get("entries", i - 1)["at"]))
    tiles = tiles.withColumn("entries", first)

    def dense(c: str) -> Column:
        zero = F.lit(0).cast("short")
        before = lambda i: F.when(i == 0, -1).otherwise(F.get("entries", i - 1)["at"])
        filled = F.flatten(F.transform("entries", lambda e, i: F.concat(F.array_repeat(zero, e["at"] - before(i) - 1), F.array(e[c]))))
        return F.concat(filled, F.array_repeat(zero, SIDE * SIDE - 1 - F.element_at("entries", -1)["at"]))

    return tiles.select(*by, "ty", "tx", *(dense(c).alias(f"tile_{c}") for c in channels))


def _source(g: str, x: Column, y: Column) -> tuple[Column, Column, Column]:
    """Column and row of the source, and the denominator, of an output place under the adjugate g."""
    row = lambda i: F.col(f"{g}.h{i}0") * x + F.col(f"{g}.h{i}1") * y + F.col(f"{g}.h{i}2")
    w = row(2)
    return row(0) / F.nullif(w, F.lit(0.0)), row(1) / F.nullif(w, F.lit(0.0)), w


def warp_pixels(pixels: DataFrame, views: DataFrame, channels: list, by: tuple = ("image_id",)) -> DataFrame:
    """by, y, x and channels of every pixel of each view of views (by, h, height, width): inverse-mapped, bilinear, rounded
    to the nearest (ties to even), black outside of the source.

    A view of an image without lit pixels is black, as is one whose h is singular; one whose h is null has no rows. Images
    without a view have none.
    """
    keys = list(by)
    tiles = settle(tile_index(pixels, channels, by), "tiles")
    reach = tiles.groupBy(*keys).agg(*(f(c).alias(f"_{c}{n}") for c in ("ty", "tx") for f, n in ((F.min, 0), (F.max, 1))))
    g, singular = adjugate(F.col("h"))
    seen = views.where("h is not null").select(*keys, g.alias("g"), singular.alias("singular"), "height", "width").join(reach, keys, "left")
    count = lambda size: F.ceil(F.col(size) / TILE).cast("int") - 1
    out = seen.where("height > 0 and width > 0").withColumn("oy", F.explode(F.sequence(F.lit(0), count("height")))).withColumn("ox", F.explode(F.sequence(F.lit(0), count("width"))))

    # The outline of an output tile in the source: where the denominator keeps its sign, its corners enclose it.
    begins = {"x": F.col("ox") * TILE, "y": F.col("oy") * TILE}
    ends = {"x": F.least((F.col("ox") + 1) * TILE, F.col("width")) - 1, "y": F.least((F.col("oy") + 1) * TILE, F.col("height")) - 1}
    corners = [_source("g", x, y) for x in (begins["x"], ends["x"]) for y in (begins["y"], ends["y"])]
    out = out.withColumns({f"_{n}{k}": c for k, corner in enumerate(corners) for n, c in zip("uvw", corner, strict=True)})
    tame = (F.least(*(f"_w{k}" for k in range(4))) > 0) | (F.greatest(*(f"_w{k}" for k in range(4))) < 0)
    tile = lambda value, low, high: F.greatest(F.least(F.floor(value / TILE), F.col(high) + 1), F.col(low) - 1).cast("int")
    for axis, name in (("v", "ty"), ("u", "tx")):
        values = [F.col(f"_{axis}{k}") for k in range(4)]
        out = out.withColumns({
            f"_from_{name}": F.when(tame, F.greatest(tile(F.floor(F.least(*values) - MARGIN), f"_{name}0", f"_{name}1"), F.col(f"_{name}0"))).otherwise(F.col(f"_{name}0")),
            f"_to_{name}": F.when(tame, F.least(tile(F.floor(F.greatest(*values) + MARGIN), f"_{name}0", f"_{name}1"), F.col(f"_{name}1"))).otherwise(F.col(f"_{name}1")),
        })
    span = lambda name: F.when(F.col(f"_from_{name}") <= F.col(f"_to_{name}"), F.sequence(f"_from_{name}", f"_to_{name}")).otherwise(F.array().cast("array<int>"))
    met = F.flatten(F.transform(span("ty"), lambda ty: F.transform(span("tx"), lambda tx: F.struct(ty.alias("ty"), tx.alias("tx")))))
    flat = [F.col(f"g.{n}").alias(n) for n in ENTRIES]
    parts = max(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), pixels.sparkSession.sparkContext.defaultParallelism)
    pairs = out.where("not singular").select(*keys, *flat, "height", "width", "oy", "ox", F.explode(met).alias("t")).select("*", "t.ty", "t.tx").drop("t")
    joined = pairs.join(tiles, [*keys, "ty", "tx"], "left").repartition(parts, *keys, "oy", "ox")

    def spots(rows: DataFrame) -> DataFrame:
        """A row for each pixel of an output tile, with its place in the source; steps are kept apart, so that the code Spark
        makes of them stays small enough to be compiled."""
        made = rows.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(TILE * TILE - 1))))
        made = made.withColumns({"y": F.col("oy") * TILE + F.shiftright("_k", BITS), "x": F.col("ox") * TILE + F.col("_k").bitwiseAND(TILE - 1)}).where("y < height and x < width").drop("_k", "height", "width")
        row = lambda i: F.col(f"h{i}0") * F.col("x") + F.col(f"h{i}1") * F.col("y") + F.col(f"h{i}2")
        made = made.withColumn("_sw", row(2)).withColumns({"_sx": row(0), "_sy": row(1)}).drop(*ENTRIES)
        lands = F.col("_sw") != 0
        made = made.withColumns({c: F.when(lands, F.col(c) / F.col("_sw")) for c in ("_sx", "_sy")}).drop("_sw")
        made = made.withColumns({"_j": F.floor("_sx"), "_i": F.floor("_sy")})
        return made.withColumns({"_ti": F.shiftright("_i", BITS), "_tj": F.shiftright("_j", BITS)})

    inside = spots(joined).where("_ti = ty and _tj = tx")
    at = ((F.col("_i") - F.col("ty") * TILE) * SIDE + F.col("_j") - F.col("tx") * TILE).cast("int")
    inside = inside.select(*keys, "y", "x", (F.col("_sy") - F.col("_i")).alias("_a"), (F.col("_sx") - F.col("_j")).alias("_b"), at.alias("_at"), *(f"tile_{c}" for c in channels))

    def value(c: str) -> Column:
        tap = lambda d: F.get(f"tile_{c}", F.col("_at") + d).cast("double")
        a, b = F.col("_a"), F.col("_b")
        mixed = (tap(0) * (1 - b) + tap(1) * b) * (1 - a) + (tap(SIDE) * (1 - b) + tap(SIDE + 1) * b) * a
        return F.coalesce(F.rint(mixed).cast("int"), F.lit(0)).alias(c)

    # What lies beyond all tiles that hold anything is black and meets none of them.
    beyond = spots(out.select(*keys, *(F.when(~F.col("singular"), F.col(f"g.{n}")).alias(n) for n in ENTRIES), "height", "width", "oy", "ox", "_ty0", "_ty1", "_tx0", "_tx1").repartition(parts, *keys, "oy", "ox"))
    beyond = beyond.where(~F.coalesce(F.expr("_ti between _ty0 and _ty1 and _tj between _tx0 and _tx1"), F.lit(False)))
    return inside.select(*keys, "y", "x", *(value(c) for c in channels)).unionAll(beyond.select(*keys, "y", "x", *(F.lit(0).alias(c) for c in channels)))


def warp(images: DataFrame, homographies: DataFrame, width: int | None = None, height: int | None = None) -> DataFrame:
    """Packed images under the homography h of their image_id; the size stays unless given."""
    size = lambda name, given: (F.col(name) if given is None else F.lit(given)).alias(name)
    views = images.select("image_id", "height", "width").join(homographies.select("image_id", "h"), "image_id").select("image_id", "h", size("height", height), size("width", width))
    return pack(warp_pixels(explode(images), views, list("bgr")), list("bgr"))


def rotate_and_translate(images: DataFrame, angle: float, dx: float, dy: float, scale: float = 1.0, shape: tuple = (800, 600), compat: bool = True) -> DataFrame:
    """Every image turned and scaled about its middle (see geometry.similarity), then moved."""
    h = similarity_of(angle, dx, dy, scale, F.col("width"), F.col("height"), compat)
    return warp(images, images.select("image_id", h.alias("h")), *shape)
