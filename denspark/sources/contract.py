"""Vectors in Parquet with the field contract that the stored Arrow schema promises.

The contract: the column is a list of fixed width of at least 1, its elements are 32-bit floats, and neither
rows nor elements may be null. Spark's own schema shows neither width nor nullability, so footers are read
in tasks, one row of figures comes back for each file, and the first file that breaks the contract is reported by its code.
Files can also be given as bytes (a binary column): they are decoded row group by row group.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from denspark.errors import INGEST
from denspark.sources.datasource import files_of, opened
from denspark.sources.readers import number_rows

_CHECKED = "name string, code string, detail string, width int, rows long"


def field_fault(schema: pa.Schema, column: str) -> tuple[str | None, str, int]:
    """(code of the first breach or None, what was found, width)."""
    at = schema.get_field_index(column)
    if at < 0:
        return "COLUMN_NOT_FOUND", column, 0
    field = schema.field(at)
    if not pa.types.is_fixed_size_list(field.type):
        return "INVALID_COLUMN_TYPE", str(field.type), 0
    child, width = field.type.value_field, field.type.list_size
    if not pa.types.is_float32(child.type):
        return "INVALID_LIST_VALUE_TYPE", str(child.type), width
    if width < 1:
        return "INVALID_DIMENSION", str(width), width
    if field.nullable:
        return "NULL_ROW", f"{column} may be null", width
    if child.nullable:
        return "NULL_VALUE", f"elements of {column} may be null", width
    return None, "", width


def _figures(name: str, file: pq.ParquetFile, column: str) -> tuple:
    code, detail, width = field_fault(file.schema_arrow, column)
    return name, code, detail, width, file.metadata.num_rows


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["name", "code", "detail", "width", "rows"])


def _judge(checked: DataFrame) -> int:
    """The common width; raises for the first breach, by the order of names."""
    bad = checked.where("code is not null").orderBy("name").limit(1).collect()
    if bad:
        raise INGEST[bad[0]["code"]](f"{bad[0]['name']}: {bad[0]['detail']}")
    all_files = checked.agg(F.min("width").alias("low"), F.max("width").alias("high"), F.sum("rows").alias("rows")).first()
    if not all_files["rows"]:
        raise INGEST["EMPTY_INPUT"]("no vectors")
    if all_files["low"] != all_files["high"]:
        raise INGEST["INVALID_ROW_LENGTH"](f"widths from {all_files['low']} to {all_files['high']}")
    return all_files["low"]


def check_parquet(spark: SparkSession, path: str, column: str = "features") -> int:
    """The width of the vectors in a Parquet file or folder; raises where a footer breaks the contract."""
    names = [x for x in files_of(path) if x.endswith(".parquet")] or files_of(path)
    parts = min(max(1, len(names)), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with opened(name) as f:
                    yield _table([_figures(name, pq.ParquetFile(f), column)])

    return _judge(spark.createDataFrame([(x,) for x in names], "name string").repartition(parts).mapInArrow(run, _CHECKED))


def vectors_from_bytes(files: DataFrame, column: str = "features") -> DataFrame:
    """(id, item) of Parquet files given as rows (name, content); ids follow the order of names and rows."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield _table([_figures(name, pq.ParquetFile(pa.BufferReader(content.as_buffer())), column)])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                file, at = pq.ParquetFile(pa.BufferReader(content.as_buffer())), 0
                for group in range(file.num_row_groups):
                    rows = file.read_row_group(group, columns=[column]).combine_chunks()
                    for part in rows.to_batches(max_chunksize=2000):
                        n = part.num_rows
                        yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(at, at + n), pa.int64()), part.column(0).cast(pa.list_(pa.float32()))], names=["name", "at", "item"])
                        at += n

    files = files.select("name", "content")
    _judge(files.mapInArrow(look, _CHECKED))
    return number_rows(files.mapInArrow(decode, "name string, at long, item array<float>"), ["name", "at"]).select("id", "item")
