"""Seeded generators of points; every row follows from (seed, id), so partitioning doesn't change it."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _uniform(seed: int, what: str) -> Column:
    """A number in (0, 1) for each id."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(what), "id"), 11).cast("double") + 0.5) / float(1 << 53)


def _normal(seed: int, what: str) -> Column:
    """Box and Muller's normal number for each id."""
    return F.sqrt(-2 * F.log(_uniform(seed, what + "/r"))) * F.cos(2 * math.pi * _uniform(seed, what + "/a"))


def _points(df: DataFrame, dims: list[Column], *more: Column) -> DataFrame:
    return df.select("id", F.array(*[d.cast("float") for d in dims]).alias("item"), *more)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def uniform(spark: SparkSession, n: int, dimension: int, seed: int = 42) -> DataFrame:
    """Points in the unit cube."""
    _need(n > 0 and dimension > 0, "points and dimension must be positive")
    return _points(spark.range(n), [_uniform(seed, f"u{j}") for j in range(dimension)])


def blobs(spark: SparkSession, n: int, dimension: int, clusters: int = 8, separation: float = 6.0, scale: float | list[float] = 0.35, seed: int = 42) -> DataFrame:
    """Gaussian blobs (id, item, label) around centres on a circle; the label is id modulo ``clusters``."""
    _need(n > 0 and dimension > 0 and clusters > 0, "points, dimension and clusters must be positive")
    scales = [scale] * dimension if isinstance(scale, (int, float)) else list(scale)
    _need(len(scales) == dimension and min(scales) > 0, "one positive scale for each axis")
    rng = np.random.default_rng(seed)
    centres = rng.uniform(-0.2 * separation, 0.2 * separation, (clusters, dimension))
    angles = 2 * math.pi * np.arange(clusters) / clusters
    centres[:, 0] = separation * np.cos(angles)
    if dimension > 1:
        centres[:, 1] = separation * np.sin(angles)
    label = F.col("id") % clusters
    dims = [F.element_at(F.lit(centres[:, j].tolist()), (label + 1).cast("int")) + scales[j] * _normal(seed, f"b{j}") for j in range(dimension)]
    return _points(spark.range(n), dims, label.alias("label"))


def ring(spark: SparkSession, n: int, dimension: int, radius: float = 7.5, thickness: float = 0.25, noise: float = 0.15, seed: int = 42) -> DataFrame:
    """A noisy circle in the first two dimensions."""
    _need(n > 0 and dimension > 1 and radius > 0, "points and radius must be positive, dimension at least 2")
    angle, r = 2 * math.pi * _uniform(seed, "angle"), radius + thickness * _normal(seed, "r")
    return _points(spark.range(n), [r * F.cos(angle), r * F.sin(angle), *[noise * _normal(seed, f"n{j}") for j in range(2, dimension)]])


def swiss_roll(spark: SparkSession, n: int, dimension: int, turns: int = 2, height: float = 10.0, noise: float = 0.1, seed: int = 42) -> DataFrame:
    """A rolled-up plane in the first three dimensions."""
    _need(n > 0 and dimension > 2 and turns > 0, "points and turns must be positive, dimension at least 3")
    t = 1.5 * math.pi * (1 + turns * _uniform(seed, "t"))
    noisy = [t * F.cos(t), height * _uniform(seed, "h"), t * F.sin(t)]
    return _points(spark.range(n), [*[x + noise * _normal(seed, f"n{j}") for j, x in enumerate(noisy)], *[noise * _normal(seed, f"n{j}") for j in range(3, dimension)]])


def mutated_text(spark: SparkSession, n: int, low: int = 6, high: int = 14, alphabet: str = "acgtxyz", templates: list[str] | None = None, edits: int = 3, seed: int = 42) -> DataFrame:
    """Strings (id, item) that are templates with up to ``edits`` random edits, of ``low`` to ``high`` characters."""
    _need(n > 0 and 0 < low <= high and len(alphabet) > 0, "lengths must be positive and in order, the alphabet not empty")
    if templates is None:
        rng = np.random.default_rng(seed)
        templates = ["".join(rng.choice(list(alphabet), rng.integers(low, high + 1))) for _ in range(8)]

    def edit(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                text = list(templates[rng.integers(len(templates))])
                for _ in range(rng.integers(edits + 1)):
                    kinds = ["replace"] * bool(text) + ["insert"] * (len(text) < high) + ["delete"] * (len(text) > low)
                    kind, at, char = rng.choice(kinds), int(rng.integers(len(text) + 1)), str(rng.choice(list(alphabet)))
                    if kind == "insert":
                        text.insert(at, char)
                    elif kind == "delete":
                        del text[min(at, len(text) - 1)]
                    else:
                        text[min(at, len(text) - 1)] = char
                out.append("".join(text))
            yield pd.DataFrame({"id": pdf["id"], "item": out})

    return spark.range(n).mapInPandas(edit, "id long, item string")
