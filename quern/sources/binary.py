"""Vector files of fixed-size records as Python data sources: fvecs and npy.

A file is cut into ranges of records, so a large one is read by many tasks, each of which opens it at its own offset.
Files are reached through pyarrow's file systems (local, hdfs, s3, gs) by the path's scheme. Options: path (a file or
a folder, files in order of their paths), n (only the first so many records), rows (records of a task, about).

Where the session has spark.sql.python.filterPushdown.enabled, comparisons of id with a number choose the records that
are read at all.
"""

from __future__ import annotations

import ast
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

#: Bytes of a task's records, and records of a batch.
TASK_BYTES, BATCH = 64_000_000, 10_000
FVECS, NPY = "quern_fvecs", "quern_npy"


@dataclass(frozen=True)
class Layout:
    """records of the file; each is stride bytes from start on, skip bytes before its dim values of type kind."""

    records: int
    start: int
    stride: int
    skip: int
    dim: int
    kind: str


@dataclass
class Range(InputPartition):
    path: str
    layout: Layout
    first: int
    after: int
    id: int

    def __init__(self, path: str, layout: Layout, first: int, after: int, id: int):
        self.path, self.layout, self.first, self.after, self.id = path, layout, first, after, id


def opened(path: str):
    """The file system that has the path, and the path there."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Files of the path by name, with their sizes; FileNotFoundError where there is none of it."""
    where, at = opened(path)
    info = where.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = where.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    found = [f for f in found if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
    prefix = path[: len(path) - len(at)] if path.endswith(at) else ""
    return sorted((prefix + f.path, f.size) for f in found)


def fvecs_layout(head: bytes, size: int) -> Layout | None:
    """Records of a little-endian int32 dimension and as many float32 values; a cut-off last one is left out."""
    if len(head) < 4:
        return None
    dim = struct.unpack("<i", head[:4])[0]
    if dim < 1:
        raise ValueError(f"no fvecs file: its first dimension is {dim}")
    return Layout(size // (4 + 4 * dim), 0, 4 + 4 * dim, 4, dim, "<f4")


def npy_layout(head: bytes, size: int) -> Layout | None:
    """A matrix of numbers in C order; records that a cut-off file lacks are left out."""
    if head[:6] != b"\x93NUMPY":
        raise ValueError("no npy file")
    long = head[6] > 1
    length = struct.unpack("<I" if long else "<H", head[8 : 12 if long else 10])[0]
    start = (12 if long else 10) + length
    facts = ast.literal_eval(head[start - length : start].decode("latin1"))
    kind, shape = np.dtype(facts["descr"]), facts["shape"]
    if facts["fortran_order"] or len(shape) != 2 or kind.kind not in "fiu":
        raise ValueError(f"a matrix of numbers in C order is needed, not {facts}")
    stride = shape[1] * kind.itemsize
    return Layout(min(shape[0], (size - start) // max(1, stride)), start, stride, 0, shape[1], kind.str)


class _Reader(DataSourceReader):
    def __init__(self, options: dict, layout):
        self.path, self.layout = options["path"], layout
        self.first, self.after = 0, int(options["n"]) if "n" in options else 2**62
        self.rows = int(options["rows"]) if "rows" in options else 0

    def partitions(self) -> list[Range]:
        out, before = [], 0
        for path, size in files(self.path):
            where, at = opened(path)
            with where.open_input_file(at) as f:
                layout = self.layout(f.read(65_536), size)
            if layout is None:
                continue
            rows = self.rows or max(1, TASK_BYTES // max(1, layout.stride))
            low, high = max(0, self.first - before), min(layout.records, self.after - before)
            out += [Range(path, layout, a, min(high, a + rows), before + a) for a in range(low, high, rows)]
            before += layout.records
        return out or [Range("", Layout(0, 0, 0, 0, 0, "<f4"), 0, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        own = part.layout
        if part.first >= part.after:
            return
        where, at = opened(part.path)
        with where.open_input_file(at) as f:
            for low in range(part.first, part.after, BATCH):
                n = min(BATCH, part.after - low)
                raw = np.frombuffer(f.read_at(n * own.stride, own.start + low * own.stride), np.uint8).reshape(n, own.stride)
                x = np.ascontiguousarray(raw[:, own.skip :]).view(own.kind).astype(np.float64)
                vec = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * own.dim), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(part.id + low - part.first + np.arange(n)), vec], ["id", "vec"])


class _NarrowingReader(_Reader):
    """For sessions that push filters down; Spark refuses such a reader in others."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons of id with a number narrow the records; what is left Spark applies itself."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("id",) or not isinstance(value, int):
                yield f
            elif isinstance(f, EqualTo):
                self.first, self.after = max(self.first, value), min(self.after, value + 1)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.after = min(self.after, value + isinstance(f, LessThanOrEqual))
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, GreaterThan))
            else:
                yield f


class FvecsSource(DataSource):
    layout = staticmethod(fvecs_layout)

    @classmethod
    def name(cls) -> str:
        return FVECS

    def schema(self) -> str:
        return "id bigint, vec array<double>"

    def reader(self, schema) -> DataSourceReader:
        own = dict(self.options)
        return (_NarrowingReader if own.get("narrow") == "true" else _Reader)(own, type(self).layout)


class NpySource(FvecsSource):
    layout = staticmethod(npy_layout)

    @classmethod
    def name(cls) -> str:
        return NPY


def _read(spark: SparkSession, source: type[DataSource], path: str, n: int | None, rows: int | None) -> DataFrame:
    files(path)  # a missing path is known before the plan
    spark.dataSource.register(source)
    given = {k: str(v) for k, v in (("n", n), ("rows", rows)) if v is not None}
    given["narrow"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format(source.name()).options(**given).load(path)


def read_fvecs(spark: SparkSession, path: str, n: int | None = None, rows: int | None = None) -> DataFrame:
    """id, vec of a file or a folder of files; ids follow the records, file after file by path.

    A cut-off last record is left out; a missing path raises FileNotFoundError. n: only the first so many records.
    rows: records that a task reads, about.
    """
    return _read(spark, FvecsSource, path, n, rows)


def read_npy(spark: SparkSession, path: str, n: int | None = None, rows: int | None = None) -> DataFrame:
    """The same from npy files, each a matrix of numbers with a vector a row."""
    return _read(spark, NpySource, path, n, rows)


load_sift = read_fvecs


def load_points(spark: SparkSession, fvecs: str, cache: str, n: int | None = None) -> DataFrame:
    """The fvecs file, else the cache (npy, else Parquet with id and vec), else FileNotFoundError."""
    try:
        return read_fvecs(spark, fvecs, n)
    except FileNotFoundError:
        if cache.rstrip("/").endswith(".npy"):
            return read_npy(spark, cache, n)
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
        if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            raise
        points = spark.read.parquet(cache)
        return points if n is None else points.where(f"id < {int(n)}")
