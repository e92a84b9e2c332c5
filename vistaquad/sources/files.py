"""Python data sources: point sets in .npy files, and a sink that leaves files under given names.

Both reach any store that pyarrow's file systems do (a mounted folder, hdfs://, s3://), from driver and executors alike.
"""

import posixpath
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

POINTS = "camera_id string, idx int, src_x double, src_y double, dst_x double, dst_y double"
ROWS = 1 << 20  # points of a partition


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else posixpath.abspath(path))


def _header(file) -> tuple[tuple, np.dtype, int]:
    """Shape, type and where the numbers begin. Arrays of Python objects are refused, as are those by columns."""
    version = np.lib.format.read_magic(file)
    shape, by_columns, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if dtype.hasobject or by_columns or len(shape) != 2 or shape[1] != 2:
        raise ValueError(f"points are an array of n x 2 numbers, not {shape} of {dtype}")
    return shape, dtype, file.tell()


@dataclass
class _Range(InputPartition):
    camera: str
    low: int
    high: int


class _PointReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.wanted = path, None

    def _sizes(self) -> dict:
        system, root = _system(self.path)
        names = [f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.is_file]
        sides = {side: {n.removesuffix(f"_{side}.npy") for n in names if n.endswith(f"_{side}.npy")} for side in ("src", "dst")}
        found = {}
        for camera in sorted(sides["src"] | sides["dst"]):
            if self.wanted is not None and camera not in self.wanted:
                continue
            lengths = []
            for side in ("src", "dst"):
                if camera not in sides[side]:
                    raise FileNotFoundError(f"{self.path}/{camera}_{side}.npy: the {'source' if side == 'src' else 'destination'} points are missing")
                with system.open_input_file(f"{root}/{camera}_{side}.npy") as file:
                    lengths.append(_header(file)[0][0])
            if lengths[0] != lengths[1]:
                raise ValueError(f"{camera}: {lengths[0]} source points, but {lengths[1]} destination points")
            found[camera] = lengths[0]
        return found

    def partitions(self):
        return [_Range(camera, at, min(at + ROWS, n)) for camera, n in self._sizes().items() for at in range(0, max(n, 1), ROWS)]

    def read(self, partition):
        if partition is None or partition.low >= partition.high:
            return
        system, root = _system(self.path)
        columns = []
        for side in ("src", "dst"):
            with system.open_input_file(f"{root}/{partition.camera}_{side}.npy") as file:
                _, dtype, begin = _header(file)
                file.seek(begin + partition.low * 2 * dtype.itemsize)
                numbers = np.frombuffer(file.read((partition.high - partition.low) * 2 * dtype.itemsize), dtype).reshape(-1, 2)
            columns += [pa.array(numbers[:, i].astype(float)) for i in range(2)]
        idx = pa.array(np.arange(partition.low, partition.high, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([pa.array([partition.camera] * len(idx)), idx, *columns], ["camera_id", "idx", "src_x", "src_y", "dst_x", "dst_y"])


class _FilteredReader(_PointReader):
    def pushFilters(self, filters):  # noqa: N802
        """camera_id = and in are used to leave files out; Spark keeps the other filters."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and tuple(f.attribute) == ("camera_id",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted = named if self.wanted is None else self.wanted & named
            else:
                yield f


class NpyPoints(DataSource):
    """spark.read.format("npy_points").load(folder): points of {camera}_src.npy and {camera}_dst.npy, row by row.

    Large files are read in ranges by several tasks. A camera without one of its files is an error that names it, as are
    files of different lengths and arrays of objects. With option("pushdown", "true"), for which the session must have
    spark.sql.python.filterPushdown.enabled, the filters camera_id = and in leave files unread.
    """

    @classmethod
    def name(cls):
        return "npy_points"

    def schema(self):
        return POINTS

    def reader(self, schema):
        return (_FilteredReader if self.options.get("pushdown", "false") == "true" else _PointReader)(self.options["path"])


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: list


class _FileWriter(DataSourceWriter):
    """Tasks write into folders of their own; only when all are through does the driver move the files to their places."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.job = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator):
        system, root = _system(self.path)
        folder, files = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            name = posixpath.normpath(row["path"] or ".")
            if name.startswith(("..", "/")) or name == ".":
                raise ValueError(f"{row['path']!r} is no path below the folder")
            system.create_dir(f"{folder}/{posixpath.dirname(name)}", recursive=True)
            with system.open_output_stream(f"{folder}/{name}", compression=None) as file:
                file.write(bytes(row["content"] or b""))
            files.append(name)
        return _Written(folder, files)

    def commit(self, messages):
        system, root = _system(self.path)
        moves = [(f"{m.folder}/{name}", f"{root}/{name}") for m in messages if m is not None for name in m.files]
        targets = [to for _, to in moves]
        there = [] if self.overwrite else [f.path for f in system.get_file_info(targets) if f.type != fs.FileType.NotFound]
        if len(set(targets)) < len(targets) or there:
            self.abort(messages)
            raise FileExistsError(f"written twice, or there already: {(there or sorted(t for t in set(targets) if targets.count(t) > 1))[:3]}")
        for source, to in moves:
            system.create_dir(posixpath.dirname(to), recursive=True)
            system.move(source, to)
        self.abort(messages)

    def abort(self, messages):
        system, root = _system(self.path)
        if system.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{root}/{self.job}")


class FileSink(DataSource):
    """df.write.format("file_sink").save(folder): a file for each row (path string below the folder, content binary).

    No file stands at its place before all tasks are through: a task that fails, is lost or runs twice leaves nothing.
    With mode("append") a file that is there already, or is written twice, is an error and nothing is written; with
    mode("overwrite") files that are there are replaced, all others stay. Null content is an empty file.
    """

    @classmethod
    def name(cls):
        return "file_sink"

    def schema(self):
        return "path string, content binary"

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyPoints)
    spark.dataSource.register(FileSink)


def read_points(spark: SparkSession, folder: str) -> DataFrame:
    register(spark)
    return spark.read.format("npy_points").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled")).load(folder)


def write_files(rows: DataFrame, folder: str, mode: str = "append") -> None:
    """rows (path, content) as files below the folder (see FileSink)."""
    register(rows.sparkSession)
    rows.select("path", "content").write.format("file_sink").mode(mode).save(folder)
