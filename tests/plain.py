"""Plain versions in numpy, of one image or one camera at a time, that the Spark jobs are held against."""

import numpy as np


def mapped(params, points):
    h = np.append(params, 1.0).reshape(3, 3)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = points @ h[:, :2].T + h[:, 2]
        return p[..., :2] / p[..., 2:]


def quad_metrics(squares, size):
    """The compat square metric of n x 4 x 2 quads, each turned about its topmost, leftmost corner."""
    x, y = squares[:, :, 0], squares[:, :, 1]
    start = np.where(y == y.min(axis=1, keepdims=True), x, np.inf).argmin(axis=1)
    q = squares[np.arange(len(squares))[:, None], (start[:, None] + np.arange(4)) % 4]
    q = q - q[:, :1]
    t = -np.arctan2(q[:, 1, 1], q[:, 1, 0])
    c, s = np.cos(t)[:, None], np.sin(t)[:, None]
    x, y = q[:, :, 0] * c - q[:, :, 1] * s, q[:, :, 0] * s + q[:, :, 1] * c
    return np.hypot(x[:, 1] - size, y[:, 1] - size) + np.hypot(x[:, 2] - size, y[:, 2]) + size


def objective(params, squares, anchors, targets, weight, size):
    total = 0.0
    if len(squares):
        moved = np.nan_to_num(mapped(params, squares).astype(np.float32), nan=0.0, posinf=0.0, neginf=0.0).astype(float)
        total += quad_metrics(moved, size).sum()
    if len(anchors):
        total += weight * np.linalg.norm(mapped(params, anchors) - targets, axis=1).sum()
    return float(total)


def warped(pixels: np.ndarray, h: np.ndarray, width: int, height: int) -> np.ndarray:
    """Inverse-mapped, bilinear, black outside; rows of the result in bands, so memory follows the band."""
    inverse, out = np.linalg.inv(h), np.zeros((height, width, pixels.shape[2]), np.uint8)
    padded = np.pad(pixels.astype(np.float32), ((1, 2), (1, 2), (0, 0)))
    for top in range(0, height, 128):
        y, x = np.mgrid[top : min(top + 128, height), :width].astype(float)
        with np.errstate(divide="ignore", invalid="ignore"):
            w = inverse[2, 0] * x + inverse[2, 1] * y + inverse[2, 2]
            u, v = ((inverse[i, 0] * x + inverse[i, 1] * y + inverse[i, 2]) / w for i in range(2))
        u, v = (np.clip(np.where(np.isfinite(a), a, -9), -1, n) for a, n in ((u, pixels.shape[1]), (v, pixels.shape[0])))
        i, j = np.floor(v).astype(int), np.floor(u).astype(int)
        a, b = (v - i)[..., None], (u - j)[..., None]
        i, j = i + 1, j + 1
        value = (padded[i, j] * (1 - b) + padded[i, j + 1] * b) * (1 - a) + (padded[i + 1, j] * (1 - b) + padded[i + 1, j + 1] * b) * a
        out[top : top + len(y)] = np.clip(np.rint(value), 0, 255)
    return out


def blurred(a: np.ndarray) -> np.ndarray:
    """Weights 1 4 6 4 1 along both axes, mirrored about the last pixel."""
    for axis in (0, 1):
        pad = [(0, 0)] * a.ndim
        pad[axis] = (2, 2)
        p = np.pad(a, pad, mode="reflect" if a.shape[axis] > 2 else "edge")
        part = lambda i: np.take(p, range(i, i + a.shape[axis]), axis=axis)  # noqa: B023, E731
        a = (part(0) + 4 * part(1) + 6 * part(2) + 4 * part(3) + part(4)) / 16
    return a


def resized(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear with half-pixel centres."""
    for axis, n in ((0, height), (1, width)):
        m = a.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
        i = np.minimum(at.astype(int), max(m - 2, 0))
        t = (at - i).reshape([-1 if k == axis else 1 for k in range(a.ndim)]).astype(np.float32)
        a = np.take(a, i, axis) * (1 - t) + np.take(a, np.minimum(i + 1, m - 1), axis) * t
    return a


def gaussian_pyramid(a: np.ndarray, levels: int) -> list:
    out = [a.astype(np.float32)]
    while len(out) < levels and min(out[-1].shape[:2]) > 1:
        out.append(resized(blurred(out[-1]), out[-1].shape[0] // 2, out[-1].shape[1] // 2))
    return out


def laplacian_pyramid(a: np.ndarray, levels: int) -> list:
    g = gaussian_pyramid(a, levels)
    return [x - resized(y, *x.shape[:2]) for x, y in zip(g, g[1:], strict=False)] + g[-1:]


def multiband_blended(one: np.ndarray, two: np.ndarray, seam: np.ndarray, levels: int = 5, compat: bool = True) -> np.ndarray:
    """Bands of both images by the smoothed seam; compat gives seam 1 to the second image, else to the first."""
    mask = [m[..., None] for m in gaussian_pyramid(seam, levels)]
    mask = mask if compat else [1 - m for m in mask]
    bands = [a * (1 - m) + b * m for a, b, m in zip(laplacian_pyramid(one, levels), laplacian_pyramid(two, levels), mask, strict=True)]
    out = bands[-1]
    for band in bands[-2::-1]:
        out = resized(out, *band.shape[:2]) + band
    out = np.clip(out, 0, 255).astype(np.uint8)
    m1, m2 = (one > 10).any(axis=2), (two > 10).any(axis=2)
    out[~m1 & ~m2] = 0
    out[m1 & ~m2], out[m2 & ~m1] = one[m1 & ~m2], two[m2 & ~m1]
    return out
