"""Readers of points: (id, item) from Parquet, Arrow, rows, CSV, text lines and IDX files, with their checks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from denspark.errors import INGEST
from denspark.lineage import cut


def number_rows(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """``df`` with ids 0, 1, ... in row order (or sorted by ``order``), in the JVM.

    A row's number is its place in its partition plus the rows of the partitions before; one count for
    each partition reaches the driver, and no task sees all rows.
    """
    df = df.orderBy(*order) if order else df
    rows = cut(df.select(F.monotonically_increasing_id().alias("id"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")))
    part = F.shiftright("id", 33)
    counts = dict(rows.groupBy(part.alias("part")).count().toArrow().to_pandas().itertuples(index=False, name=None))
    before, starts = 0, []
    for k in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(k, 0)
    start = F.element_at(F.lit(starts or [0]).cast("array<bigint>"), part.cast("int") + 1)
    return rows.select((start + F.col("id").bitwiseAND((1 << 33) - 1)).alias("id"), "row.*")


def vector_faults(column: str, dimension: int) -> dict[str, Column]:
    """What ingestion rejects, by code: whether a row has the fault."""
    v = F.col(column)
    return {
        "NULL_ROW": v.isNull(),
        "INVALID_ROW_LENGTH": F.coalesce(F.size(v) != dimension, F.lit(False)) & v.isNotNull(),
        "NULL_VALUE": F.coalesce(F.exists(v, lambda x: x.isNull()), F.lit(False)),
    }


def check_vectors(points: DataFrame, column: str = "item") -> int:
    """The dimension of the vectors; raises for null rows, null elements and other lengths, with the first id (and element). One aggregate."""
    v = F.col(column)
    size = points.where(v.isNotNull()).select(F.size(v).alias("d")).limit(1).collect()
    if not size:
        raise INGEST["NULL_ROW" if points.limit(1).count() else "EMPTY_INPUT"]("no vectors")
    d = size[0]["d"]
    if d == 0:
        raise INGEST["INVALID_DIMENSION"]("vectors have no elements")
    faults = vector_faults(column, d)
    element = F.array_position(F.transform(v, lambda x: x.isNull()), F.lit(True)) - 1
    first = points.agg(*[F.min(F.when(x, F.struct("id", element.alias("element")))).alias(code) for code, x in faults.items()]).first()
    for code in faults:
        if first[code] is not None:
            row, at = first[code]
            raise INGEST[code](f"row {row}" + (f", element {at}" if code == "NULL_VALUE" else ""), row=row)
    return d


def bad_rows(points: DataFrame, dimension: int, column: str = "item") -> DataFrame:
    """(id, reason) of the vectors that ingestion rejects, by the first fault."""
    reason = F.coalesce(*[F.when(x, code) for code, x in vector_faults(column, dimension).items()])
    return points.select("id", reason.alias("reason")).where("reason is not null")


def clean_line(line: Column) -> Column:
    """A line without the carriage returns and line feeds at its end."""
    return F.regexp_replace(line, r"[\r\n]+$", "")


def _vectors(df: DataFrame, column: str, id_column: str | None) -> DataFrame:
    if column not in df.columns:
        raise INGEST["COLUMN_NOT_FOUND"](column)
    kind = df.schema[column].dataType
    if not isinstance(kind, T.ArrayType):
        raise INGEST["INVALID_COLUMN_TYPE"](str(kind))
    if not isinstance(kind.elementType, T.FloatType):
        raise INGEST["INVALID_LIST_VALUE_TYPE"](str(kind.elementType))
    if id_column:
        points = df.select(F.col(id_column).cast("long").alias("id"), F.col(column).alias("item"))
    else:
        points = number_rows(df.select(F.col(column).alias("item")))
    check_vectors(points)
    return points


def vectors_from_parquet(spark: SparkSession, path: str, column: str = "features", id_column: str | None = None, strict: bool = False) -> DataFrame:
    """Float vectors of one column; only that column (and the id) is read. With ``strict`` the footers must promise
    a fixed width and no nulls (:mod:`denspark.sources.contract`)."""
    if strict:
        from denspark.sources.contract import check_parquet

        check_parquet(spark, path, column)
    return _vectors(spark.read.parquet(path), column, id_column)


def vectors_from_arrow(spark: SparkSession, table: pa.Table, column: str) -> DataFrame:
    """Float vectors of an Arrow table."""
    return _vectors(spark.createDataFrame(table), column, None)


def vectors_from_rows(spark: SparkSession, rows: list) -> DataFrame:
    """Float vectors given as lists."""
    if not rows:
        raise INGEST["EMPTY_INPUT"]("no rows")
    made = [(i, None if r is None else [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)]
    points = spark.createDataFrame(made, "id long, item array<float>")
    check_vectors(points)
    return points


def vectors_from_csv(spark: SparkSession, path: str, dimension: int) -> DataFrame:
    """Float vectors of a CSV file without a header."""
    names = [f"c{i}" for i in range(dimension)]
    df = spark.read.csv(path, schema=", ".join(f"{n} float" for n in names))
    points = number_rows(df.select(F.array(*names).alias("item")))
    check_vectors(points)
    return points


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One item for each line, blank ones too, without the carriage returns at its end."""
    df = spark.read.text(path, lineSep="\n").select(clean_line(F.col("value")).alias("item"))
    points = number_rows(df)
    if points.isEmpty():
        raise INGEST["EMPTY_INPUT"](path)
    return points


def idx_images(spark: SparkSession, path: str, magic: int = 2051) -> DataFrame:
    """Images of IDX files (gzip or plain) as float vectors, one task a file; ``file`` and ``at`` order them."""

    def decode(batches):
        import gzip

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else bytes(content)
                found, n, h, w = struct.unpack(">iiii", data[:16])
                if found != magic:
                    raise ValueError(f"{name}: magic {found}, not {magic}")
                pixels = np.frombuffer(data, np.uint8, n * h * w, 16).reshape(n, h * w)
                for k in range(0, n, 1000):
                    part = pixels[k : k + 1000].astype(np.float32)
                    yield pd.DataFrame({"file": name, "at": np.arange(k, k + len(part)), "item": list(part)})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return number_rows(files.mapInPandas(decode, "file string, at long, item array<float>"), ["file", "at"]).select("id", "item")
