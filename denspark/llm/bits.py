"""Tables of fixed size that tasks fill and get back: bits, for a first test whose misses are certain, and blocks of sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of one block.
_BLOCK = 1 << 20
#: Bits for each key, and the most that a table has: with more keys it only lets more through.
BITS, MOST = 8, 1 << 28
#: Lots in which blocks of sums are added up before they meet.
LOTS = 64


def table_size(keys: int) -> int:
    """Bits of a table for that many keys, a power of two."""
    return min(MOST, max(_BLOCK, 1 << (BITS * keys).bit_length()))


def held(bits: np.ndarray, cell: np.ndarray) -> np.ndarray:
    """Which cells are set in a packed table; cells may be of any size."""
    cell = cell.view(np.int64) & (len(bits) * 8 - 1)
    return (bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)


def added_up(blocks: DataFrame, add: Callable, schema: str, n: int) -> DataFrame:
    """Blocks (block, ...) of all tasks added up by ``add`` (a function for mapInArrow), first within lots of tasks and
    then over these, so that no task reads what all tasks wrote; ``n``: number of different blocks."""
    some = blocks.withColumn("lot", F.spark_partition_id() % LOTS).repartition(n * 4, "block", "lot").drop("lot").mapInArrow(add, schema)
    return some.repartition(n, "block").mapInArrow(add, schema)


def _set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        cells = batch.column(0).to_numpy()
        for block in np.unique(cells // _BLOCK).tolist():
            if block not in held:
                held[block] = np.zeros(_BLOCK // 8, np.uint8)
            own = np.zeros(_BLOCK, bool)
            own[cells[cells // _BLOCK == block] % _BLOCK] = True
            held[block] |= np.packbits(own)
    for block, bits in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bits.tobytes()], pa.binary())], names=["block", "bits"])


def bit_table(cells: DataFrame, size: int) -> np.ndarray:
    """``size`` bits, packed, with those of column ``cell`` set. Each block of bits is filled by one task as its
    cells stream past; the driver gets size / 8 bytes whatever the number of rows."""
    out = np.zeros(max(size, _BLOCK) // 8, np.uint8)
    blocks = max(1, size // _BLOCK)
    rows = cells.select(F.col("cell").cast("long").alias("cell")).repartition(min(blocks, 128), F.shiftright("cell", 20))
    for x in rows.mapInArrow(_set, "block int, bits binary").toArrow().to_pylist():
        at = x["block"] * _BLOCK // 8
        out[at : at + _BLOCK // 8] |= np.frombuffer(x["bits"], np.uint8)
    return out
