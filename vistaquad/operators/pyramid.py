"""Pyramids and multi-band blending as pixel relations of several resolutions.

A level is a relation (keys, y, x, _h, _w, values) of all images at once, values as doubles. Blurring and resampling go
along one axis after the other: a window along the axis gives a pixel its next one, and each pixel makes the output places
that lie between the two, so a level takes two exchanges by image rows and columns and no image is ever whole in a task.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vistaquad.operators.raster import non_black, taps
from vistaquad.operators.stitch import byte, seam_mask
from vistaquad.sources.shared import settle

AXES = (("x", "y", "_w"), ("y", "x", "_h"))


def resample(rows: DataFrame, axis: str, other: str, size: str, to: str, values: list, by: tuple) -> DataFrame:
    """rows of `size` places along the axis to `to` places (columns): bilinear with half-pixel centres, ends held."""
    along = Window.partitionBy(*by, other).orderBy(axis)
    m, n, x = F.col(size), F.col(to), F.col(axis)
    following = rows.withColumns({f"_n_{v}": F.coalesce(F.lead(v).over(along), F.col(v)) for v in values})
    low = F.when(x == 0, 0).otherwise(F.greatest(F.lit(0), F.floor((x + 0.5) * n / m - 0.5) - 1)).cast("int")
    high = F.when(x >= m - 2, n - 1).otherwise(F.least(n - 1, F.ceil((x + 1.5) * n / m - 0.5) + 1)).cast("int")
    made = following.withColumn("_k", F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))))
    at = F.greatest(F.lit(0.0), F.least(m - 1.0, (F.col("_k") + 0.5) * m / n - 0.5))
    placed = made.withColumn("_at", at).withColumn("_i", F.least(F.floor("_at"), F.greatest(m - 2, F.lit(0)))).where(F.col("_i") == x)
    placed = placed.withColumn("_t", F.col("_at") - F.col("_i"))
    mixed = {v: F.col(v) * (1 - F.col("_t")) + F.col(f"_n_{v}") * F.col("_t") for v in values}
    return placed.withColumns(mixed).withColumn(axis, F.col("_k")).drop("_k", "_at", "_i", "_t", *(f"_n_{v}" for v in values))


def halved(rows: DataFrame, values: list, by: tuple) -> DataFrame:
    """The next level: blurred (1 4 6 4 1, mirrored) and resampled to half the size, rounded down. Images with a side of one
    pixel have none. _ph and _pw keep the size they come from."""
    found = rows.where("_h > 1 and _w > 1").withColumns({"_ph": F.col("_h"), "_pw": F.col("_w")})
    for axis, other, size in AXES:
        along = Window.partitionBy(*by, other).orderBy(axis)
        found = found.withColumns({v: taps(F.col(v), axis, along) / 16 for v in values})
        found = resample(found.withColumn("_to", F.floor(F.col(size) / 2).cast("int")), axis, other, size, "_to", values, by).withColumn(size, F.col("_to")).drop("_to")
    return found


def expanded(rows: DataFrame, values: list, by: tuple) -> DataFrame:
    """A level resampled to the size that it comes from."""
    for (axis, other, size), to in zip(AXES, ("_pw", "_ph"), strict=True):
        rows = resample(rows, axis, other, size, to, values, by)
    return rows


def gaussian(rows: DataFrame, values: list, levels: int, by: tuple) -> list:
    """Levels of rows (keys, y, x, values), settled; sizes come from the largest y and x. Images have no gaps."""
    base = rows.select(*by, "y", "x", *(F.col(v).cast("double").alias(v) for v in values))
    sizes = base.groupBy(*by).agg((F.max("y") + 1).cast("int").alias("_h"), (F.max("x") + 1).cast("int").alias("_w"))
    found = [settle(base.join(sizes, list(by)), "level")]
    while len(found) < levels:
        found.append(settle(halved(found[-1], values, by), "level"))
    return found


def multiband(rows: DataFrame, channels: list, levels: int = 5, compat: bool = True, by: tuple = ("pair_id",), size: tuple | None = None) -> DataFrame:
    """pairs (see raster.pairs) to pixels by, y, x and channels, blended band by band along the smoothed seam.

    compat gives what the seam says is the first image's to the second, else to the first. Where only one image is lit
    (above 10) it is taken as it is; where neither is, the result is black. A pair too small for all levels has fewer.
    size: see stitch.seam_mask.
    """
    masked = seam_mask(rows, channels, by, size=size)
    share = F.col("seam") if compat else 1 - F.col("seam")
    ones, twos, values = [f"{c}1" for c in channels], [f"{c}2" for c in channels], [*(f"{c}{n}" for n in (1, 2) for c in channels), "_m"]
    pyramid = gaussian(masked.withColumn("_m", share), values, levels, by)
    keys, out = [*by, "y", "x"], [f"_o_{c}" for c in channels]
    mixed = lambda a, b: a * (1 - F.col("_m")) + b * F.col("_m")
    blended = pyramid[-1].withColumns({o: mixed(F.col(a), F.col(b)) for o, a, b in zip(out, ones, twos, strict=True)})
    for level in pyramid[-2::-1]:
        above = expanded(blended, [*ones, *twos, *out], by).select(*keys, *(F.col(v).alias(f"_u_{v}") for v in (*ones, *twos, *out)))
        met = level.join(above, keys, "left")
        up = lambda v: F.coalesce(f"_u_{v}", F.lit(0.0))
        bands = {o: up(o) + mixed(F.col(a) - up(a), F.col(b) - up(b)) for o, a, b in zip(out, ones, twos, strict=True)}
        blended = settle(met.withColumns(bands).drop(*(f"_u_{v}" for v in (*ones, *twos, *out))), "bands")
    one, two = non_black(ones, 10), non_black(twos, 10)
    final = lambda c, o: F.when(one & two, byte(F.col(o))).when(one, F.col(f"{c}1").cast("int")).when(two, F.col(f"{c}2").cast("int")).otherwise(0).alias(c)
    return blended.select(*keys, *(final(c, o) for c, o in zip(channels, out, strict=True)))
