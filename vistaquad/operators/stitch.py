"""Stitching of two views on pixel relations: joins on (pair, y, x), aggregates and windows by image row.

Operators take pairs (see raster.pairs) with channels c1 and c2 and give channels c; groups are pixel rows, so a hot
pair of images is spread over its rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaquad.operators.raster import blur, difference, non_black
from vistaquad.sources.shared import settle
from vistaquad.sources.store import is_owned


def byte(x):
    """Clipped to 0..255 and cut off, as a byte image stores it."""
    return F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), x.cast("double")))).cast("int")


def fixed_overlap(one: DataFrame, other: DataFrame, channels: list, width: int, overlap: int = 100, by: tuple = ("pair_id",)) -> DataFrame:
    """Two images of one size, the second shifted right by width - overlap and laid over the first per channel where above 0."""
    if width < overlap:
        raise ValueError("the images are narrower than the overlap")
    shifted = other.withColumn("x", F.col("x") + (width - overlap))
    named = lambda df, n: df.select(*by, "y", "x", *(F.col(c).alias(f"{c}{n}") for c in channels))
    both = named(one, 1).join(named(shifted, 2), [*by, "y", "x"], "full")
    return both.select(*by, "y", "x", *(F.when(F.col(f"{c}2") > 0, F.col(f"{c}2")).otherwise(F.coalesce(f"{c}1", F.lit(0))).alias(c) for c in channels))


def first_wins(rows: DataFrame, channels: list, by: tuple = ("pair_id",), level: int = 10) -> DataFrame:
    """The first image where above level, else the second where above it, else black; cropped to what is above it.

    rows: pairs with how="full". A pair without such a pixel has no rows.
    """
    one, two = (non_black([f"{c}{n}" for c in channels], level) for n in (1, 2))
    seen = rows.withColumns({"_one": one, "_two": two})
    box = seen.where("_one or _two").groupBy(*by).agg(*(f(c).alias(f"_{c}{n}") for c in "yx" for f, n in ((F.min, 0), (F.max, 1))))
    inside = seen.join(box, list(by)).where("y between _y0 and _y1 and x between _x0 and _x1")
    return inside.select(*by, (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"), *(F.when(F.col("_one"), F.col(f"{c}1")).when(F.col("_two"), F.col(f"{c}2")).otherwise(0).alias(c) for c in channels))


def blend(rows: DataFrame, channels: list, by: tuple = ("pair_id",), alpha: float = 0.5, compat: bool = True) -> DataFrame:
    """alpha of the first plus, in compat, alpha of the second (else 1 - alpha); compat also dims what one image has alone."""
    one, two = (non_black([f"{c}{n}" for c in channels], 0) for n in (1, 2))
    a = F.lit(alpha).cast("float")
    rest = a if compat else F.lit(1 - alpha).cast("float")
    alone = a if compat else F.lit(1.0).cast("float")
    f = lambda name: F.col(name).cast("float")
    return rows.select(*by, "y", "x", *(byte(F.when(one & two, f(f"{c}1") * a + f(f"{c}2") * rest).when(one, f(f"{c}1") * alone).when(two, f(f"{c}2") * alone).otherwise(0)).alias(c) for c in channels))


def seam_rows(rows: DataFrame, channels: list, by: tuple = ("pair_id",), size: tuple | None = None) -> DataFrame:
    """Pairs with masks, blurred difference and, for rows of pixels with overlap, its span (x_start, x_end) and its first
    least column (best_x); windows by row of pixels in one exchange, no join. size: see raster.blur; columns without a
    blurred difference come last."""
    marked = blur(difference(rows, channels), "diff", by, size=size)
    row = Window.partitionBy(*by, "y")
    shared = F.when(F.col("overlap"), F.col("x"))
    spanned = marked.withColumns({"x_start": F.min(shared).over(row), "x_end": F.max(shared).over(row)})
    inside = F.when(F.expr("x between x_start and x_end"), F.struct(F.col("blur").isNull(), "blur", "x"))
    return spanned.withColumn("best_x", F.min(inside).over(row)["x"])


def seam_mask(rows: DataFrame, channels: list, by: tuple = ("pair_id",), image: tuple | None = None, size: tuple | None = None) -> DataFrame:
    """seam_rows with seam: 1 where the first image is taken. Rows whose overlap spans 5 columns or less take the second.

    Without any overlap the boundary lies halfway between the mean columns, or the mask is the first image's. Of rows in
    bands (see sources.store; by has band), image names the keys without it; rows of halos come out, too. size: see seam_rows.
    """
    if image is None:
        image, marked = by, settle(seam_rows(rows, channels, by, size), "seam")  # read twice: by pixel, and for the whole of a pair
        once = marked
    else:  # stored tables are joined again instead, without an exchange
        marked = seam_rows(rows, channels, by, size)
        once = difference(rows, channels).where(is_owned())
    mean = lambda n: F.avg(F.when(F.col(f"mask{n}"), F.col("x")))
    whole = once.groupBy(*image).agg(F.max("overlap").alias("_any"), F.floor((mean(1) + mean(2)) / 2).alias("_boundary"))
    cut = (F.col("x_end") - F.col("x_start") > 5) & (F.col("x") >= F.col("x_start")) & (F.col("x") < F.col("best_x"))
    apart = F.coalesce(F.col("x") < F.col("_boundary"), F.col("mask1"))
    seam = F.when(F.col("_any"), F.coalesce(cut, F.lit(False)) | (F.col("mask1") & ~F.col("mask2"))).otherwise(apart)
    return marked.join(whole, list(image)).withColumn("seam", seam.cast("int")).drop("_any", "_boundary")


def feather(rows: DataFrame, channels: list, by: tuple = ("pair_id",), width: int = 20, image: tuple | None = None, size: tuple | None = None) -> DataFrame:
    """Seam stitch with a ramp of the given width about the row's first transition, within the overlap's span.

    The second image's weight rises to the seam, starts again at 0 there and rises again; weight 0 means no ramp. image and size: see seam_mask.
    """
    row = Window.partitionBy(*by, "y")
    before = F.lag("seam").over(row.orderBy("x"))
    turned = seam_mask(rows, channels, by, image, size).withColumn("_turn", F.when(F.col("seam") != before, F.col("x")))
    placed = turned.withColumn("seam_x", F.min("_turn").over(row))
    one = F.lit(1.0).cast("float")
    x, s = F.col("x"), F.col("seam_x")
    inside = (x >= F.greatest("x_start", s - width)) & (x < F.least("x_end", s + width))
    ramp = F.when(x < s, F.greatest(F.lit(0.0), 1 - (s - x) / F.lit(float(width)))).otherwise(F.least(F.lit(1.0), (x - s) / F.lit(float(width))))
    m = F.when(inside, ramp).otherwise(F.lit(0.0)).cast("float")
    f = lambda name: F.col(name).cast("float")
    return placed.withColumn("_m", m).select(*by, "y", "x", *(byte(F.when(F.col("_m") > 0, f(f"{c}1") * (one - F.col("_m")) + f(f"{c}2") * F.col("_m")).when(F.col("seam") == 1, f(f"{c}1")).otherwise(f(f"{c}2"))).alias(c) for c in channels))
