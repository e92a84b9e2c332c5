"""Images: packed rows, pixel relations, and PNG."""

import struct
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistaquad.sources import schema


HEAD = 1 << 17  # bytes of a file in which its orientation is looked for; the segment that holds it comes first


def orientation_of(head: bytes) -> int:
    """The orientation (1 to 8) that a JPEG file's EXIF segment tells; 1 where there is none or it is broken."""
    at = 2
    while head[:2] == b"\xff\xd8" and at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] != 0xDA:
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
            tiff = head[at + 10 : at + 2 + size]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            number = lambda i, n: int.from_bytes(tiff[i : i + n], order)  # noqa: B023, E731
            first = number(4, 4) if order else len(tiff)
            for k in range(number(first, 2) if order else 0):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112 and entry + 12 <= len(tiff):
                    return number(entry + 8, 2) if 1 <= number(entry + 8, 2) <= 8 else 1
        at += 2 + max(size, 2)
    return 1


def upright(pixels: np.ndarray, orientation: int) -> np.ndarray:
    """The array as it is to be seen: 5 to 8 swap the axes; then columns and rows are mirrored."""
    pixels = pixels.swapaxes(0, 1) if orientation >= 5 else pixels
    pixels = pixels[:, ::-1] if orientation in (2, 3, 6, 7) else pixels
    return pixels[::-1] if orientation in (3, 4, 7, 8) else pixels


def _turned(frames):
    for frame in frames:
        yield pd.DataFrame([row_of(r.image_id, upright(array_of(r), int(r.orientation))) for r in frame.itertuples()], columns=["image_id", "height", "width", "channels", "data"])


def read_images(spark: SparkSession, path: str, oriented: bool = True) -> DataFrame:
    """Images by Spark's image source; files that can't be decoded are left out. oriented turns JPEG files as their EXIF
    segment tells; files without one stay as they are and take no detour through Python."""
    found = spark.read.format("image").option("dropInvalid", True).load(path)
    packed = found.select(F.col("image.origin").alias("image_id"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))
    if not oriented:
        return packed
    same = lambda column: F.regexp_replace(column, "^([a-z0-9]+):/+", "$1:/")
    told = F.pandas_udf(lambda heads: heads.map(orientation_of), "int")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[jJ][pP]*").load(path)
    turned = files.select(same("path").alias("_file"), told(F.substring("content", 1, HEAD)).alias("orientation")).where("orientation > 1")
    rows = packed.withColumn("_file", same("image_id"))
    names = packed.columns
    return rows.join(turned, "_file", "left_anti").select(names).unionAll(rows.join(turned, "_file").select(*names, "orientation").mapInPandas(_turned, schema.IMAGES))


def array_of(row) -> np.ndarray:
    """A packed image as an array of height, width and channels."""
    return np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.channels)


def row_of(image_id, pixels: np.ndarray) -> tuple:
    pixels = np.ascontiguousarray(pixels if pixels.ndim == 3 else pixels[:, :, None], np.uint8)
    return (image_id, *pixels.shape, pixels.tobytes())


def _exploded(frames):
    for frame in frames:
        for row in frame.itertuples():
            pixels = array_of(row)
            y, x = np.mgrid[: row.height, : row.width]
            out = {"image_id": row.image_id, "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32)}
            for i, name in enumerate("bgr"):
                out[name] = pixels[:, :, min(i, row.channels - 1)].ravel().astype(np.int32)
            yield pd.DataFrame(out)


def explode(images: DataFrame) -> DataFrame:
    """Pixel relation: image_id, y, x, b, g, r; gray images have it in all three."""
    return images.mapInPandas(_exploded, "image_id string, y int, x int, b int, g int, r int")


def pack(pixels: DataFrame, channels: list) -> DataFrame:
    """Pixel relation to packed images; a group is one image, which the raster tier holds whole anyhow. Gaps are black."""

    def run(key, table):
        y, x, *values = (table.column(c).to_numpy() for c in ("y", "x", *channels))
        out = np.zeros((y.max() + 1, x.max() + 1, len(channels)), np.uint8)
        for i, v in enumerate(values):
            out[y, x, i] = v
        return pa.Table.from_pylist([dict(zip(names, row_of(key[0].as_py(), out), strict=True))], made)

    names, made = ["image_id", "height", "width", "channels", "data"], pa.schema([("image_id", pa.string()), *((n, pa.int32()) for n in ("height", "width", "channels")), ("data", pa.binary())])
    return pixels.select("image_id", "y", "x", *channels).groupBy("image_id").applyInArrow(run, schema.IMAGES)


def png(pixels: np.ndarray) -> bytes:
    """PNG file of a gray or blue-green-red array."""
    pixels = pixels[:, :, ::-1] if pixels.ndim == 3 and pixels.shape[2] == 3 else pixels.reshape(pixels.shape[:2])
    h, w = pixels.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(pixels).reshape(h, -1)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 2 if pixels.ndim == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def encode_png(images: DataFrame) -> DataFrame:
    """image_id and content: the image as a PNG file, ready for a table or an object store."""

    def run(frames):
        for frame in frames:
            yield pd.DataFrame({"image_id": frame["image_id"], "content": [png(array_of(r)) for r in frame.itertuples()]})

    return images.mapInPandas(run, "image_id string, content binary")
