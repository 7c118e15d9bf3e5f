"""Metrics, as Column expressions for joins and as NumPy blocks for the blocked searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from denspark.errors import DISTANCE, INDEX


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    """Distance of two arrays, summed in double and returned as float."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)).cast("float")


def norm(a: Column) -> Column:
    """Euclidean length of an array, in double."""
    return F.sqrt(_dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """1 minus the cosine, in [0, 2]; a vector of length 0 raises an error. Norms may be given."""
    na, nb = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    similarity = F.when((na > 0) & (nb > 0), _dot(a, b) / (na * nb)).otherwise(F.raise_error(F.lit("ZERO_MAGNITUDE")).cast("double")).cast("float")
    return (F.lit(1.0).cast("float") - F.greatest(F.lit(-1.0).cast("float"), F.least(F.lit(1.0).cast("float"), similarity))).cast("float")


def levenshtein(a: Column, b: Column) -> Column:
    """Edit distance in characters."""
    return F.levenshtein(a, b).cast("float")


def absolute(a: Column, b: Column) -> Column:
    """Distance of two numbers."""
    return F.abs(a.cast("double") - b.cast("double")).cast("float")


def _euclidean_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty((len(a), len(b)), np.float32)
    b = b.astype(np.float64)
    # Direct differences: the Gram form loses the small distances and their ties.
    for i, x in enumerate(a.astype(np.float64)):
        out[i] = np.sqrt(((b - x) ** 2).sum(1))
    return out


def _cosine_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    if not (na > 0).all() or not (nb > 0).all():
        raise DISTANCE["ZERO_MAGNITUDE"]("a vector has length 0")
    return np.float32(1) - np.clip((a @ b.T / na[:, None] / nb[None]).astype(np.float32), -1, 1)


#: Pairs of texts that are compared at once: their working words stay in a CPU's cache.
PAIRS = 1 << 16
_TOP, _ONE = np.uint64(63), np.uint64(1)


def _code_points(texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts one after the other, and how many each has."""
    joined = "".join(texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), np.fromiter(map(len, texts), np.int64, len(texts))


def _levenshtein_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of all pairs, 64 rows of the table in one word and many pairs at once.

    A text of ``a`` is a column of words, one bit for each code point; every code point of ``b`` moves all
    pairs on by one column. Bits say where the table rises or falls from row to row, and carries take that
    from word to word. Texts of ``b`` are sorted by length, so that those that have ended are left out.
    """
    out = np.zeros((len(a), len(b)), np.float32)
    if not len(a) or not len(b):
        return out
    points_a, size_a = _code_points(a)
    points_b, size_b = _code_points(b)
    alphabet, codes = np.unique(np.concatenate([points_a, points_b]), return_inverse=True)
    begin_a = np.cumsum(size_a) - size_a
    order = np.argsort(size_b, kind="stable")
    length = size_b[order]
    longest = int(length[-1])
    text = np.zeros((longest, len(b)), np.int64)
    place = np.arange(len(points_b)) - np.repeat(np.cumsum(size_b) - size_b, size_b)
    column = np.empty(len(b), np.int64)
    column[order] = np.arange(len(b))
    text[place, np.repeat(column, size_b)] = codes[len(points_a) :]
    alive = np.searchsorted(length, np.arange(longest), "right")
    for words in np.unique(-(-size_a // 64)).tolist():
        rows = np.flatnonzero(-(-size_a // 64) == words)
        if words == 0:
            out[np.ix_(rows, order)] = length
            continue
        step = max(1, PAIRS // len(b))
        for at in range(0, len(rows), step):
            own = rows[at : at + step]
            equal = np.zeros((words, len(own), len(alphabet)), np.uint64)
            for k, r in enumerate(own.tolist()):
                i = np.arange(size_a[r])
                np.bitwise_or.at(equal, (i >> 6, k, codes[begin_a[r] + i]), _ONE << (i & 63).astype(np.uint64))
            out[np.ix_(own, order)] = _edit_columns(equal, size_a[own], text, alive, length)
    return out


def _edit_columns(equal: np.ndarray, size: np.ndarray, text: np.ndarray, alive: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Distances of patterns (``equal``: words x patterns x code points) and texts (columns of ``text``)."""
    words, n, _ = equal.shape
    up = np.full((words, n, text.shape[1]), ~np.uint64(0))
    down = np.zeros_like(up)
    score = np.repeat(size[:, None], text.shape[1], 1)
    last = ((size - 1) & 63).astype(np.uint64)[:, None]
    for t, first in enumerate(alive.tolist()):
        # The table's first row rises by one in each column.
        rise, fall = np.ones((n, text.shape[1] - first), np.uint64), np.zeros((n, text.shape[1] - first), np.uint64)
        for w in range(words):
            same = equal[w][:, text[t, first:]]
            p, m = up[w][:, first:], down[w][:, first:]
            across = same | m
            same = same | fall
            x = (((same & p) + p) ^ p) | same
            high, low = m | ~(x | p), p & x
            top = last if w == words - 1 else _TOP
            out_rise, out_fall = high >> top & _ONE, low >> top & _ONE
            high, low = high << _ONE | rise, low << _ONE | fall
            up[w][:, first:] = low | ~(across | high)
            down[w][:, first:] = high & across
            rise, fall = out_rise, out_fall
        score[:, first:] += rise.astype(np.int64) - fall.astype(np.int64)
    return score


@dataclass(frozen=True)
class Metric:
    """A symmetric distance: ``column`` for joins, ``block`` for two arrays of items (may be left out)."""

    name: str
    column: Callable[[Column, Column], Column]
    block: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


EUCLIDEAN = Metric("euclidean", euclidean, _euclidean_block)
COSINE = Metric("cosine", cosine, _cosine_block)
LEVENSHTEIN = Metric("levenshtein", levenshtein, _levenshtein_block)
ABSOLUTE = Metric("absolute", absolute, lambda a, b: np.abs(a.astype(np.float64)[:, None] - b.astype(np.float64)[None]).astype(np.float32))
METRICS = {m.name: m for m in (EUCLIDEAN, COSINE, LEVENSHTEIN, ABSOLUTE)}


def pair_distances(pairs: DataFrame, points: DataFrame, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(source, target) with ``distance``, looked up in points (id, item)."""
    left = points.select(F.col("id").alias("source"), F.col("item").alias("_a"))
    right = points.select(F.col("id").alias("target"), F.col("item").alias("_b"))
    return pairs.join(left, "source").join(right, "target").select("source", "target", metric.column(F.col("_a"), F.col("_b")).alias("distance"))


def check_finite(edges: DataFrame, column: str = "distance") -> DataFrame:
    """The edges as they are; raises where a distance is NaN or infinite (one aggregate, before anything else runs)."""
    bad = edges.where(~(F.abs(F.col(column)) < float("inf")) | F.col(column).isNull()).select("source", "target").limit(1).collect()
    if bad:
        raise INDEX["NON_FINITE_DISTANCE"](f"distance of {bad[0]['source']} and {bad[0]['target']} isn't finite")
    return edges
