"""IDX images and generated points as data sources: ``spark.read.format("idx")`` and ``spark.read.format("points")``.

A read is planned from a file's header (or from the number of points) and cut into ranges of ids. Each
partition reads its own range only, in batches of ``BATCH`` rows, so no file is one value or one task. A file packed with gzip can't
be entered in its middle: its ranges unpack what comes before them and drop it as it streams past.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Rows of a batch, and of a partition where no number of partitions is asked for.
BATCH, ROWS = 2000, 50_000
_HEADER = 16
_SCHEMA = pa.schema([("id", pa.int64()), ("item", pa.list_(pa.float32()))])
_LABELLED = pa.schema([*_SCHEMA, ("label", pa.int64())])


def opened(path: str):
    """A file for reading, by any path that Arrow's file systems know."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def files_of(path: str) -> list[str]:
    """The file, or the files of a folder in the order of their names."""
    prefix = ""
    if "://" in path or path.startswith("file:"):
        system, inner = fs.FileSystem.from_uri(path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    else:
        system, inner = fs.LocalFileSystem(), path
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [path]
    return [prefix + x.path for x in sorted(system.get_file_info(fs.FileSelector(inner)), key=lambda x: x.path) if x.type == fs.FileType.File and not x.base_name.startswith((".", "_"))]


@dataclass
class Range(InputPartition):
    """Rows ``low`` to ``high`` (exclusive) of a file (or of generated points), whose first row has the id ``first``."""

    path: str
    first: int
    low: int
    high: int


def ranges(path: str, first: int, n: int, parts: int | None) -> list[Range]:
    size = max(1, -(-n // parts) if parts else ROWS)
    return [Range(path, first, a, min(n, a + size)) for a in range(0, n, size)]


def _is_packed(path: str) -> bool:
    with opened(path) as f:
        return f.read(2) == b"\x1f\x8b"


def header(path: str, magic: int) -> tuple[int, int]:
    """Images of an IDX file and numbers of each."""
    with opened(path) as f:
        start = f.read(2)
    packed = start == b"\x1f\x8b"
    with opened(path) as f:
        data = gzip.GzipFile(fileobj=f).read(_HEADER) if packed else f.read(_HEADER)
    if len(data) < _HEADER:
        raise ValueError(f"{path}: no header")
    found, n, height, width = struct.unpack(">iiii", data)
    if found != magic:
        raise ValueError(f"{path}: magic {found}, not {magic}")
    return n, height * width


class IdxReader(DataSourceReader):
    def __init__(self, options):
        self.magic = int(options.get("magic", 2051))
        self.parts = int(options["partitions"]) if "partitions" in options else None
        self.paths = files_of(options["path"])

    def partitions(self) -> list[Range]:
        out, first = [], 0
        for path in self.paths:
            n, _ = header(path, self.magic)
            out += ranges(path, first, n, self.parts)
            first += n
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.low == partition.high:
            return
        _, size = header(partition.path, self.magic)
        with opened(partition.path) as f:
            data = gzip.GzipFile(fileobj=f) if _is_packed(partition.path) else f
            data.seek(_HEADER + partition.low * size)
            for at in range(partition.low, partition.high, BATCH):
                n = min(BATCH, partition.high - at)
                raw = data.read(n * size)
                if len(raw) < n * size:
                    raise ValueError(f"{partition.path}: ends before image {at + n}")
                values = np.frombuffer(raw, np.uint8).astype(np.float32)
                items = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * size, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(partition.first + np.arange(at, at + n)), items], schema=_SCHEMA)


class IdxSource(DataSource):
    """Options: ``path`` (a file or a folder), ``magic``, ``partitions`` of each file."""

    @classmethod
    def name(cls) -> str:
        return "idx"

    def schema(self) -> str:
        return "id bigint, item array<float>"

    def reader(self, schema) -> IdxReader:
        return IdxReader(self.options)


def _mixed(seed: int, what: int, ids: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that follow from seed, place and id alone."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 0x1000193 + what * 0x85EBCA77) & 0xFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-54


class PointsReader(DataSourceReader):
    def __init__(self, options):
        self.n, self.dimension, self.seed = int(options["n"]), int(options["dimension"]), int(options.get("seed", 42))
        self.clusters, self.scale = int(options.get("clusters", 0)), float(options.get("scale", 0.05))
        self.parts = int(options["partitions"]) if "partitions" in options else None
        if self.n < 1 or self.dimension < 1 or self.clusters < 0:
            raise ValueError("points and dimension must be positive")

    def partitions(self) -> list[Range]:
        return ranges("", 0, self.n, self.parts)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        d = self.dimension
        for at in range(partition.low, partition.high, BATCH):
            ids = np.arange(at, min(at + BATCH, partition.high))
            u = np.stack([_mixed(self.seed, j, ids) for j in range(d)], 1)
            label = np.zeros(len(ids), np.int64)
            if self.clusters:
                label = ids % self.clusters
                centres = np.stack([_mixed(self.seed, 10_000 + j, np.arange(self.clusters)) for j in range(d)], 1)
                angle = np.stack([_mixed(self.seed, 20_000 + j, ids) for j in range(d)], 1)
                u = centres[label] + self.scale * np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * angle)
            items = pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * d, pa.int32()), pa.array(u.astype(np.float32).ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids), items, pa.array(label)], schema=_LABELLED)


class PointsSource(DataSource):
    """Points in the unit cube, or blobs around ``clusters`` centres in it. Options: ``n``, ``dimension``, ``seed``, ``clusters``, ``scale``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "points"

    def schema(self) -> str:
        return "id bigint, item array<float>, label bigint"

    def reader(self, schema) -> PointsReader:
        return PointsReader(self.options)


def register(spark) -> None:
    """Makes the formats ``idx`` and ``points`` known to the session."""
    for source in (IdxSource, PointsSource):
        spark.dataSource.register(source)
