"""Points under homographies, as column expressions.

A homography is a struct of doubles h00..h22. Input points are rounded to float first, as stored calibration points are.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRIES = [f"h{i}{j}" for i in range(3) for j in range(3)]
EPSILON = 1.1920929e-07  # of float; a smaller denominator counts as zero in mode "cv"


def homography(values) -> Column:
    """A literal from nine numbers, row by row, or eight with h22 = 1."""
    values = [*values, 1.0][:9]
    return F.struct(*(F.lit(float(v)).alias(n) for n, v in zip(ENTRIES, values, strict=True)))


def from_params(params: Column) -> Column:
    """Eight parameters (array) to a homography with h22 = 1."""
    return F.struct(*(F.element_at(params, i + 1).alias(n) for i, n in enumerate(ENTRIES[:8])), F.lit(1.0).alias("h22"))


def to_params(h: Column) -> Column:
    """The first eight entries as they are, without division by h22."""
    return F.array(*(h[n] for n in ENTRIES[:8]))


def compose(a: Column, b: Column) -> Column:
    """The matrix product a b."""
    return F.struct(*(sum((a[f"h{i}{k}"] * b[f"h{k}{j}"] for k in range(1, 3)), a[f"h{i}0"] * b[f"h0{j}"]).alias(f"h{i}{j}") for i in range(3) for j in range(3)))


def similarity(angle: float, dx: float, dy: float, scale: float, width: int, height: int, compat: bool = True) -> list:
    """Nine numbers: rotation by angle (degrees) and scale about the middle, then a shift.

    compat takes (height // 2, width // 2) as the middle's (x, y), which differs from the image's unless it is square.
    """
    import math

    cx, cy = (height // 2, width // 2) if compat else (width // 2, height // 2)
    a, b = scale * math.cos(math.radians(angle)), scale * math.sin(math.radians(angle))
    return [a, b, (1 - a) * cx - b * cy + dx, -b, a, b * cx + (1 - a) * cy + dy, 0.0, 0.0, 1.0]


def similarity_of(angle: float, dx: float, dy: float, scale: float, width: Column, height: Column, compat: bool = True) -> Column:
    """similarity for sizes that are columns."""
    import math

    cx, cy = (F.floor(v / 2).cast("double") for v in ((height, width) if compat else (width, height)))
    a, b = scale * math.cos(math.radians(angle)), scale * math.sin(math.radians(angle))
    values = [F.lit(a), F.lit(b), (1 - a) * cx - b * cy + dx, F.lit(-b), F.lit(a), b * cx + (1 - a) * cy + dy, F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return F.struct(*(v.cast("double").alias(n) for n, v in zip(ENTRIES, values, strict=True)))


def adjugate(h: Column) -> tuple[Column, Column]:
    """The inverse of h up to a factor, which points don't notice, and whether there is none."""
    minor = lambda a, b, c, d: h[a] * h[d] - h[b] * h[c]
    rows = [("h11", "h12", "h21", "h22"), ("h02", "h01", "h22", "h21"), ("h01", "h02", "h11", "h12"), ("h12", "h10", "h22", "h20"), ("h00", "h02", "h20", "h22"), ("h02", "h00", "h12", "h10"), ("h10", "h11", "h20", "h21"), ("h01", "h00", "h21", "h20"), ("h00", "h01", "h10", "h11")]
    entries = [minor(*r) for r in rows]
    total = h["h00"] * entries[0] + h["h01"] * entries[3] + h["h02"] * entries[6]
    return F.struct(*(e.alias(n) for n, e in zip(ENTRIES, entries, strict=True))), total == 0


def as_float(x: Column) -> Column:
    return x.cast("float").cast("double")


def project(h: Column, x: Column, y: Column, mode: str = "np") -> tuple[Column, Column]:
    """(u, v) of a point. Where the denominator is 0, mode "np" gives infinities or NaN, mode "cv" gives 0.

    Mode "cv" also rounds the result to float. Null coordinates give null.
    """
    x, y = as_float(x), as_float(y)
    w = h["h20"] * x + h["h21"] * y + h["h22"]
    out = []
    for i in range(2):
        top = h[f"h{i}0"] * x + h[f"h{i}1"] * y + h[f"h{i}2"]
        if mode == "cv":
            out.append(as_float(F.when(F.abs(w) > EPSILON, top / F.nullif(w, F.lit(0.0))).when(w.isNotNull(), F.lit(0.0))))
        else:
            limit = F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))
            out.append(F.when(w == 0, limit).otherwise(top / F.nullif(w, F.lit(0.0))))
    return out[0], out[1]


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors; NaN if one is zero."""
    norms = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = (ax * bx + ay * by) / F.nullif(norms, F.lit(0.0))
    return F.when(norms == 0, F.lit(float("nan"))).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), cosine)))))


def improvement(initial: Column, optimized: Column) -> tuple[Column, Column]:
    """Difference and percent of the initial error; 0 percent where that isn't positive."""
    gain = initial - optimized
    return gain, F.when(initial > 0, gain / F.nullif(initial, F.lit(0.0)) * 100).otherwise(F.lit(0.0))
