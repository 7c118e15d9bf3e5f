"""Small arithmetic: sizes, medians, basis points, densities."""

from __future__ import annotations

import re
from pathlib import PurePath

from pyspark.sql import Column
from pyspark.sql import functions as F

U64 = (1 << 64) - 1
# Fixed values of the memory estimate: bytes per link, node, cache entry, candidate edge, core distance, forest edge.
LINK, NODE, CACHE_ENTRY, CACHE_ENTRIES, EDGE, CORE, TREE_EDGE = 8, 80, 80, 1_048_576, 32, 4, 32


def estimate_peak_bytes(points: int, m: int = 16) -> int:
    """Bytes that a run over ``points`` is expected to hold: 1.5 times graph, cache, edges and tree; saturates at 2**64 - 1."""
    if points == 0:
        return 0
    parts = points * 2 * m * LINK + points * NODE + CACHE_ENTRIES * CACHE_ENTRY + points * m * EDGE * 2 + points * CORE + points * TREE_EDGE
    return min(U64, parts + parts // 2)


def format_bytes(n: int) -> str:
    """``1536`` as ``1.5 KiB``."""
    units = ["KiB", "MiB", "GiB", "TiB"]
    if n < 1024:
        return f"{n} B"
    value = float(n)
    for unit in units:
        value /= 1024
        if value < 1024 or unit == units[-1]:
            return f"{value:.1f} {unit}"
    raise AssertionError


def parse_byte_size(text: str) -> int:
    """``512M``, ``2 GiB``, ``10kb``: bytes with base 1024."""
    m = re.fullmatch(r"\s*([0-9]+)\s*([kmgt]?)(?:i?b)?\s*", text.lower())
    if not m:
        raise ValueError(f"not a size in bytes: {text!r}")
    value = int(m[1]) << 10 * " kmgt".index(m[2] or " ")
    if value > U64:
        raise OverflowError(f"too many bytes: {text!r}")
    return value


def source_name(path: str, name: str | None = None) -> str:
    """The given name, or else the file's stem, or else ``data_source``."""
    return name or PurePath(path).stem or "data_source"


def query_index(i: int, n: int, queries: int = 50) -> int:
    """The i-th of evenly spaced rows among n."""
    return (i + 1) * n // (queries + 1)


def resolve_ef(m: int, ef: int) -> int:
    """``ef``, or twice ``m`` where it is 0."""
    return ef or 2 * m


def effective_ef(n: int, min_cluster_size: int, ef: int) -> int:
    """Neighbours to look at for core distances."""
    return min(n, max(min_cluster_size + 1, ef))


def lane_basis_points(count: Column, lanes: int = 16) -> Column:
    """Share of SIMD lanes in use when ``count`` is padded to whole registers, in 1/10000."""
    padded = F.ceil(count / lanes) * lanes
    return F.when(count > 0, F.floor(count * 10_000 / padded)).otherwise(0).cast("long")


def duration_basis_points(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in 1/10000, rounded and clamped; 0 without a whole."""
    return F.when(whole > 0, F.least(F.lit(10_000), F.greatest(F.lit(0), F.round(part * 10_000 / whole)))).otherwise(0).cast("long")


def floor_median(values: Column) -> Column:
    """Aggregate: integer median, the floor of the midpoint."""
    return F.floor(F.percentile(values, F.lit(0.5))).cast("long")


def weight_to_lambda(weight: Column) -> Column:
    """Density of a distance: its inverse, infinite at 0."""
    return F.when(weight == 0, F.lit(float("inf"))).otherwise(F.lit(1.0) / F.when(weight != 0, weight))
