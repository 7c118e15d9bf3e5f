"""Vectorised text primitives that run inside Spark tasks on Arrow batches.

An Arrow string column is one byte buffer with offsets. Words, word hashes and
shingles of all documents of a slice are computed from that buffer at once; a
slice is a run of whole documents of about ``SLICE`` bytes (a longer document is
a slice of its own), so memory follows the longest document, not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
SLICE = 1_000_000
_U = np.uint64
_MULT = 0x9E3779B97F4A7C15
_INV = pow(_MULT, -1, 1 << 64)

#: ASCII white space that separates words (space and \x09-\x0D).
SPACES = b"\t\n\x0b\x0c\r "

_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> _U(31))
    h = h * _U(0x7FB5D329728EA185)
    h = h ^ (h >> _U(27))
    h = h * _U(0x81DADEF4BC2DD44D)
    return h ^ (h >> _U(33))


def _byte_table(lower: bool) -> np.ndarray:
    """A random 64-bit value per byte; with ``lower`` A-Z share the values of a-z; white space is 0."""
    table = mix(np.arange(1, 257, dtype=_U) * _U(0xD6E8FEB86659FD93))
    if lower:
        table[65:91] = table[97:123]
    table[_SPACE] = 0
    return table


_TABLES = {flag: _byte_table(flag) for flag in (False, True)}
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``m**i`` and ``m**-i`` modulo 2**64 for i below n; grown on demand and kept."""
    if len(_powers[0]) < n:
        size = max(n, SLICE + 2)
        for k, base in enumerate((_MULT, _INV)):
            steps = np.full(size, base, _U)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with nulls as empty strings."""
    col = batch.column(batch.schema.get_field_index(name))
    return pc.fill_null(col, "") if col.null_count else col


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back to the system: a Python worker lives on from task to task, with all that it ever held otherwise."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(col: pa.Array, limit: int = SLICE, most: int = 2000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first row, bytes, offsets from 0) for runs of at most ``most`` whole documents."""
    if len(col) == 0:
        return
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        stop = int(np.searchsorted(offs, offs[row] + limit, "right")) - 1
        stop = min(max(row + 1, stop), row + most, len(col))
        yield row, raw[offs[row] : offs[stop]], offs[row : stop + 1] - offs[row]
        row = stop
    if len(raw) > limit:
        release()


def spans(mask: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and exclusive ends of the maximal runs of ``mask`` that don't cross documents."""
    if len(mask) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(mask) + 1, bool)
    edge[offs] = True
    starts, ends = mask.copy(), mask.copy()
    starts[1:] &= edge[1:-1] | ~mask[:-1]
    ends[:-1] &= edge[1:-1] | ~mask[1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice.

    ``starts`` and ``ends`` are byte positions, ``hashes`` 64-bit values (A-Z folded to a-z with
    ``lower``) and ``bounds`` the word offsets of each document.
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray, lower: bool = True):
        self.starts, self.ends = spans(~_SPACE[raw], offs)
        self.bounds = np.searchsorted(self.starts, offs)
        up, down = powers(len(raw) + 1)
        if len(self.starts):
            sums = np.add.reduceat(_TABLES[lower][raw] * up[:-1], self.starts)
            self.hashes = mix(sums * down[self.starts])
        else:
            self.hashes = np.zeros(0, _U)


def windows(h: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows of each document (fewer words: none) and their bounds by document."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, _U)
    for j in range(size):
        out += mix(h[j : j + n] + _U(j * 0x1000193 + 1))
    counts = np.maximum(np.diff(bounds) - size + 1, 0)
    new = np.concatenate([[0], np.cumsum(counts)])
    keep = np.arange(new[-1]) + np.repeat(bounds[:-1] - new[:-1], counts)
    return mix(out[keep]), new


def shingle_sets(raw: np.ndarray, offs: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """Sorted distinct ``size``-word shingle hashes of each document; with fewer words, one for the whole sequence."""
    words = Words(raw, offs)
    hashes, bounds = windows(words.hashes, words.bounds, size)
    out = []
    for d in range(len(offs) - 1):
        a, b = words.bounds[d], words.bounds[d + 1]
        if b - a >= size:
            out.append(np.unique(hashes[bounds[d] : bounds[d + 1]]))
        elif b > a:
            whole = np.arange(b - a, dtype=_U) * _U(0x1000193) + words.hashes[a:b] + _U(1)
            out.append(mix(np.array([mix(whole).sum() + _U(int(b - a) * 0xC2B2AE3D)], _U)))
        else:
            out.append(np.zeros(0, _U))
    return out


def code_points(raw: np.ndarray) -> np.ndarray:
    """True at the first byte of each UTF-8 code point."""
    return (raw & 0xC0) != 0x80


def sums_by(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive offsets (empty stretches give 0)."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of the given schema from arrays or lists."""
    made = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(made, schema=schema)
