"""Joins and searches of texts within a few edits, by a segment index.

A text is cut into ``edits + 1`` segments. Whoever is within ``edits`` edits of it holds one of them
unchanged, and not far from its place: if the first segments hold as many edits as there are of them, segment i (from 0)
has i edits before it and at most ``edits - i`` behind. So segments are indexed by (length of the text,
number, segment), and a text looks up the pieces of its own that stand within these shifts, for each
length that is near enough. Candidates are verified by their edit distance as they are met; a pair that was met
by several segments stays once.

Texts are made distinct first, so equal rows cost nothing until the pairs are written. Texts too short
for as many segments are met block by block with all that are near them in length (both have at most
``2 * edits`` characters). Null texts match nothing; an empty text is a text of length 0; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.functions.distance import LEVENSHTEIN
from denspark.lineage import cut
from denspark.operators.knn import Rows, _held_and_streamed, _near, groups_of


def _segments(edits: int) -> str:
    """SQL: array of (size, number, piece) of column ``text`` of length ``size``."""
    n = edits + 1
    base, longer = f"(size div {n})", f"({n} - size % {n})"
    return f"transform(sequence(0, {edits}), i -> named_struct('size', size, 'number', i, 'piece', substring(text, i * {base} + greatest(0, i - {longer}) + 1, {base} + if(i >= {longer}, 1, 0))))"


def _lookups(edits: int, longest: str) -> str:
    """SQL: array of the (size, number, piece) that ``text`` looks up, for texts of up to ``longest`` characters."""
    n = edits + 1
    base, longer = f"(l div {n})", f"({n} - l % {n})"
    begin, size = f"(i * {base} + greatest(0, i - {longer}))", f"({base} + if(i >= {longer}, 1, 0))"
    low = f"greatest(0, {begin} - i, {begin} + size - l - ({edits} - i))"
    high = f"least(size - {size}, {begin} + i, {begin} + size - l + ({edits} - i))"
    places = f"if({low} <= {high}, sequence({low}, greatest({low}, {high})), cast(array() as array<int>))"
    pieces = f"transform({places}, p -> named_struct('size', l, 'number', i, 'piece', substring(text, p + 1, {size})))"
    lengths = f"if({longest} >= greatest({n}, size - {edits}), sequence(greatest({n}, size - {edits}), greatest({longest}, {n}, size - {edits})), cast(array() as array<int>))"
    return f"array_distinct(flatten(transform({lengths}, l -> flatten(transform(sequence(0, {edits}), i -> {pieces})))))"


def _texts(points: DataFrame) -> DataFrame:
    return points.where("item is not null").select(F.col("item").alias("text")).distinct().withColumn("size", F.char_length("text"))


def _short(left: DataFrame, right: DataFrame, edits: int) -> DataFrame:
    """(a, b, edits) of texts of ``left`` and ``right`` (text), block against block."""
    spark = left.sparkSession
    tasks = spark.sparkContext.defaultParallelism
    n, m = groups_of(left.count(), tasks), groups_of(right.count(), tasks)

    def meet(q: Rows, c: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        for i, j, d in _near(q, c, LEVENSHTEIN, lambda w: np.full(len(w), float(edits))):
            keep = d <= edits
            yield pa.RecordBatch.from_arrays([pa.array(q["item"][i[keep]], pa.string()), pa.array(c["item"][j[keep]], pa.string()), pa.array(d[keep], pa.int32())], names=["a", "b", "edits"])

    def dealt(rows: DataFrame, role: int) -> DataFrame:
        own, other = (n, m) if role == 0 else (m, n)
        mine = F.pmod(F.xxhash64("text"), F.lit(own)).cast("int").alias(f"key{role}")
        return rows.select(mine, F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(f"key{1 - role}"), F.lit(role).alias("role"), F.col("text").alias("item"))

    rows = dealt(left, 0).unionByName(dealt(right, 1))
    return rows.repartition(n * m, "key0", "key1").sortWithinPartitions("key0", "key1", "role").mapInArrow(_held_and_streamed(meet, ["item"], 2, False), "a string, b string, edits int")


def _verified(left: DataFrame, right: DataFrame, edits: int, once: bool) -> DataFrame:
    """(a, b, edits): texts of ``left`` that look up segments of texts of ``right``; with ``once`` each pair from one side."""
    index = right.where(F.col("size") > edits).select(F.col("text").alias("b"), F.explode(F.expr(_segments(edits))).alias("key"))
    asked = left.select(F.col("text").alias("a"), F.explode(F.expr(_lookups(edits, "size" if once else f"(size + {edits})"))).alias("key"))
    near = F.levenshtein(F.col("a"), F.col("b"), edits)
    pairs = asked.join(index, "key").where(near >= 0)
    if once:
        pairs = pairs.where((F.char_length("b") < F.char_length("a")) | (F.col("b") < F.col("a")))
    return pairs.select("a", "b", near.alias("edits")).distinct()


def _with_ids(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    x = left.select(F.col("id").cast("long").alias("id_a"), F.col("item").alias("a"))
    y = right.select(F.col("id").cast("long").alias("id_b"), F.col("item").alias("b"))
    return pairs.join(x, "a").join(y, "b").select("id_a", "id_b", F.col("edits").cast("float").alias("distance"))


def edit_join(points: DataFrame, edits: int) -> DataFrame:
    """(source, target, distance), source < target, of points (id, item) whose texts are within ``edits`` edits."""
    texts = cut(_texts(points))
    found = _verified(texts, texts, edits, True)
    few = cut(texts.where(F.col("size") <= 2 * edits).select("text", "size"))
    if edits and not few.isEmpty():
        # Here the shorter text has no segments: at most ``edits`` characters, whatever the other has.
        short = _short(few.where(F.col("size") <= edits), few, edits).where("a <> b and (char_length(a) < char_length(b) or (char_length(a) = char_length(b) and a < b))")
        found = found.unionByName(short)
    other = _with_ids(found, points, points)
    other = other.select(F.least("id_a", "id_b").alias("source"), F.greatest("id_a", "id_b").alias("target"), "distance")
    rows = points.where("item is not null").select(F.col("id").cast("long").alias("id"), "item")
    same = rows.select(F.col("id").alias("source"), "item").join(rows.select(F.col("id").alias("target"), "item"), "item").where("source < target")
    return other.unionByName(same.select("source", "target", F.lit(0.0).cast("float").alias("distance")))


def edit_search(points: DataFrame, queries: DataFrame, edits: int) -> DataFrame:
    """(query, id, distance): the points within ``edits`` edits of each query (id, item); a query that is a point comes with itself."""
    texts, asked = cut(_texts(points)), cut(_texts(queries))
    found = _verified(asked, texts, edits, False)
    few = texts.where(F.col("size") <= edits)
    ask = asked.where(F.col("size") <= 2 * edits)
    if not few.isEmpty():
        found = found.unionByName(_short(ask, few, edits))
    return _with_ids(found, queries, points).select(F.col("id_a").alias("query"), F.col("id_b").alias("id"), "distance")
