"""Nearest neighbours: exact search in groups, range join, and an approximate search of measured recall.

Points are (id, item). Results are (query, id, distance, rank), ordered by (distance, id).

Metrics that work on arrays are searched group against group: a task gets two groups of points as
Arrow batches, holds one and streams the other past it. Euclidean distances are first estimated by
a matrix product; those that can matter are worked out as differences, so that results and ties are
the same as by definition.
"""

from __future__ import annotations

import itertools
import logging
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from denspark.functions.distance import COSINE, EUCLIDEAN, Metric
from denspark.lineage import cut
from denspark.sources.readers import number_rows

log = logging.getLogger(__name__)

#: Points of a group, least points that are worth a group, distances held at once, pairs worked out at once.
GROUP, LEAST, TILE, EXACT = 20_000, 250, 2_000_000, 100_000
#: Cells of the approximate search at most; its sample of queries, and the share of their neighbours that the cells looked into must hold.
CELLS, SAMPLE, TARGET = 1 << 14, 256, 0.95
#: Most edits for which texts are joined by their segments.
EDITS = 8
#: Candidates of a query, about, that may come of looking at fewer columns for the bound of its k-th distance.
FEWER = 64
#: Columns of products of which one stands for all in the bound of the k-th, and elements of vectors up to which products are made in double precision.
WIDTH, NARROW = 24, 16
#: Points of a group whose pairs all become rows: a task makes their square. Targets in a run of one source, as many as a run of packed values of Parquet holds.
PAIRED, RUN = 4000, 504
_FOUND = "query long, id long, distance float"

Rows = dict[str, np.ndarray]


def best(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest (distance, id) of each query among (query, id, distance)."""
    order = Window.partitionBy("query").orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query", "id", "distance", "rank")


def brute_force(points: DataFrame, k: int, queries: DataFrame | None = None, metric: Metric = EUCLIDEAN, with_self: bool = False) -> DataFrame:
    """Exact neighbours by a join of all pairs, for small inputs and any metric that is a Column."""
    q = (points if queries is None else queries).select(F.col("id").alias("query"), F.col("item").alias("_q"))
    pairs = q.crossJoin(points)
    pairs = pairs if with_self else pairs.where(F.col("query") != F.col("id"))
    return best(pairs.select("query", "id", metric.column(F.col("_q"), F.col("item")).alias("distance")), k)


def _column(values: pa.Array) -> np.ndarray:
    if pa.types.is_list(values.type) or pa.types.is_large_list(values.type):
        return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)
    return values.to_numpy(zero_copy_only=False)


def _rows(parts: list[pa.RecordBatch], names: list[str]) -> Rows:
    return {name: np.concatenate([_column(p.column(p.schema.get_field_index(name))) for p in parts]) for name in names}


def _length(rows: Rows) -> int:
    return len(rows["id"])


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows equal in ``keys``, as they stream past in batches."""
    for batch in batches:
        if batch.num_rows:
            of = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in keys]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in of], axis=0)) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows], strict=True):
                yield tuple(int(x[a]) for x in of), batch.slice(a, b - a)


def _held_and_streamed(meet: Callable[[Rows, Rows, bool], Iterator[pa.RecordBatch]], names: list[str], n_keys: int, alone: bool):
    """For rows sorted by keys and role: those of role 0 are held, and those of role 1 meet them as they stream past.

    With ``alone`` a group without a second one meets itself.
    """
    keys = [f"key{i}" for i in range(n_keys)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, held = None, [], None
        for (*key, role), part in _runs(batches, [*keys, "role"]):
            if key != at:
                if alone and parts and held is None:
                    own = _rows(parts, names)
                    yield from meet(own, own, True)
                at, parts, held = key, [], None
            if role == 0:
                parts.append(part)
            elif parts:
                held = _rows(parts, names) if held is None else held
                yield from meet(held, _rows([part], names), False)
        if alone and parts and held is None:
            own = _rows(parts, names)
            yield from meet(own, own, True)

    return run


def groups_of(n: int, tasks: int, most: int | None = None) -> int:
    """Groups for n points: bounded in size (``most``, else GROUP), and enough to keep ``tasks`` tasks busy where points are worth it."""
    return max(1, -(-n // (most or GROUP)), min(int(np.ceil(np.sqrt(2 * tasks))), n // LEAST))


def meet_all(points: DataFrame, meet: Callable[[Rows, Rows, bool], Iterator[pa.RecordBatch]], schema: str, n: int | None = None, most: int | None = None, ranked: bool = False) -> DataFrame:
    """What ``meet`` (rows, rows, whether they are the same) gives for every unordered pair of groups of points, itself included.

    A point travels once for each group, and a pair of groups is a task. ``ranked``: ids are 0..n-1, groups are ranges of them,
    and the first rows that meet are those of the lower range.
    """
    spark = points.sparkSession
    n = points.count() if n is None else n
    count = groups_of(n, spark.sparkContext.defaultParallelism, most)
    group = F.floor(F.col("id") * count / max(1, n)) if ranked else F.pmod(F.xxhash64("id"), F.lit(count))
    rows = points.select("*", group.cast("int").alias("group"))
    rows = rows.select(*points.columns, "group", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("other"))
    keyed = rows.select(F.least("group", "other").alias("key0"), F.greatest("group", "other").alias("key1"), (F.col("group") > F.col("other")).cast("int").alias("role"), *points.columns)
    # Pairs are numbered by rows of their triangle: hashes would put several into one task and none into others.
    dealt = keyed.repartitionById(count * (count + 1) // 2, F.expr(f"key0 * ({2 * count - 1} - key0) div 2 + key1").cast("int"))
    return dealt.sortWithinPartitions("key0", "key1", "role").mapInArrow(_held_and_streamed(meet, points.columns, 2, True), schema)


def _near(q: Rows, c: Rows, metric: Metric, reach: Callable[[np.ndarray], np.ndarray], weigh: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of pairs within ``reach``, tile by tile.

    ``reach``: the limit of each row of (estimated) distances; ``weigh``: (distances, i, j) -> what is
    compared with it, infinite for pairs that don't count (i, j are places or slices of them).
    """
    a, b = q["item"], c["item"]
    squares = metric is EUCLIDEAN or metric.name == EUCLIDEAN.name
    if squares:
        a, b = a.astype(np.float64), b.astype(np.float64)
        na, nb = (a * a).sum(1), (b * b).sum(1)
        squares = bool(np.isfinite(na).all() and np.isfinite(nb).all())
    step = max(1, TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        rows = slice(at, min(len(a), at + step))
        if squares:
            d = np.sqrt(np.maximum(na[rows, None] + nb[None] - 2 * (a[rows] @ b.T), 0))
            slack = 2e-6 * np.sqrt(na[rows] + nb.max(initial=0.0))
        else:
            d = metric.block(q["item"][rows], c["item"])
            slack = np.zeros(len(d))
        w = d if weigh is None else weigh(d, rows, slice(None))
        limit = reach(w)
        with np.errstate(invalid="ignore"):
            # Not "within": distances that are no numbers come out as well.
            i, j = np.nonzero(~(w > (limit * (1 + 5e-7) + slack)[:, None]))
        if not squares:
            yield i + at, j, d[i, j]
            continue
        for k in range(0, len(i), EXACT):
            x, y = i[k : k + EXACT] + at, j[k : k + EXACT]
            yield x, y, np.sqrt(((b[y] - a[x]) ** 2).sum(1)).astype(np.float32)


def estimated(a: np.ndarray, b: np.ndarray, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all pairs, and by how much each row's may be wrong (Euclidean ones come from a matrix product)."""
    if metric.name != EUCLIDEAN.name:
        return metric.block(a, b), np.zeros(len(a))
    a, b = a.astype(np.float64), b.astype(np.float64)
    na, nb = (a * a).sum(1), (b * b).sum(1)
    return np.sqrt(np.maximum(na[:, None] + nb - 2 * (a @ b.T), 0)), 2e-6 * np.sqrt(na + nb.max(initial=0.0))


def _scored(q: Rows, c: Rows, metric: Metric) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """(a, b, squares of a, squares of b), so that a's rows by b's rank c for each q: the higher their product, the nearer. None: no such form.

    Euclidean: a.b - |b|^2 / 2, as one more column; cosine: both of length 1.
    """
    if metric.name not in (EUCLIDEAN.name, COSINE.name):
        return None
    a, b = q["item"].astype(np.float64), c["item"].astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        na, nb = (a * a).sum(1), (b * b).sum(1)
    if not (np.isfinite(na).all() and np.isfinite(nb).all()):
        return None
    if metric.name == EUCLIDEAN.name:
        return np.hstack([a, np.ones((len(a), 1))]), np.hstack([b, -nb[:, None] / 2]), na, nb
    if not (na > 0).all() or not (nb > 0).all():
        return None
    return a / np.sqrt(na)[:, None], b / np.sqrt(nb)[:, None], np.ones(len(a)), np.ones(len(b))


def _ranked(q: Rows, c: Rows, k: int, metric: Metric, skip_self: bool, scored: tuple) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of pairs that can be among the k nearest of each q, tile by tile: one product and two passes over it.

    Products are made in single precision, with bounds for what rounding may do, and in double where these bounds leave too many pairs.
    """
    a, b, na, nb = scored
    x, y = q["item"].astype(np.float64), c["item"].astype(np.float64)
    lengths = None if metric.name == EUCLIDEAN.name else (np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    m, d = len(b), a.shape[1]
    single = d > NARROW and max(na.max(), nb.max()) < 1e30
    left, right = (v.astype(np.float32) if single else v for v in (a, b))
    # Where a query is itself among the points.
    order = np.argsort(c["id"], kind="stable")
    low, high = (np.searchsorted(c["id"][order], q["id"], side) for side in ("left", "right"))
    if not skip_self:
        high = low
    width = max(1, min(WIDTH, m // (16 * k)))
    heads = m // width
    step = max(1, TILE // m)
    at = 0
    while at < len(a):
        rows = slice(at, min(len(a), at + step))
        s = left[rows] @ right.T
        own = np.repeat(np.arange(len(s)), (high - low)[rows])
        if len(own):
            first = np.repeat(low[rows] - np.cumsum((high - low)[rows]) + (high - low)[rows], (high - low)[rows])
            s[own, order[first + np.arange(len(own))]] = -np.inf
        if heads < k:
            need = np.full(len(s), -np.inf)
        else:
            # The k-th of the greatest of every ``width`` columns is a bound of the k-th of all, and seldom lower.
            head = s[:, : heads * width].reshape(len(s), width, heads).max(1) if width > 1 else s
            kth = np.partition(head, heads - k, axis=1)[:, heads - k].astype(np.float64)
            wrong = (d + 8) * (2.0**-24 if single else 2.0**-53) * (na[rows] + nb.max()) + (1e-37 if single else 1e-300)
            # What the result's own rounding may make equal to the k-th.
            even = 4e-7 if lengths else np.maximum(na[rows] - 2 * kth, 0) * 6e-7
            need = kth - even - 2 * wrong
        found = np.flatnonzero(s >= np.nextafter(need.astype(s.dtype), s.dtype.type(-np.inf))[:, None])
        if single and len(found) > 3 * min(k, m) * len(s):
            single, left, right = False, a, b
            continue
        i, j = np.divmod(found, m)
        keep = s[i, j] > -np.inf
        i, j = i[keep] + at, j[keep]
        for begin in range(0, len(i), EXACT):
            u, v = i[begin : begin + EXACT], j[begin : begin + EXACT]
            if lengths:
                similarity = np.einsum("ij,ij->i", x[u], y[v]) / lengths[0][u] / lengths[1][v]
                yield u, v, np.float32(1) - np.clip(similarity.astype(np.float32), -1, 1)
            else:
                yield u, v, np.sqrt(((y[v] - x[u]) ** 2).sum(1)).astype(np.float32)
        at = rows.stop


def _top(q: Rows, c: Rows, k: int, metric: Metric, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """(query, id, distance): the k nearest of c to each of q, some more where distances are equal to rounding."""

    def reach(d: np.ndarray) -> np.ndarray:
        # A few of the columns bound the k-th distance as well, and choosing among them is most of the work.
        step = max(1, min(FEWER // k, d.shape[1] // (4 * k)))
        d = d[:, ::step]
        most = min(k, d.shape[1]) - 1
        limit = np.partition(d, most, axis=1)[:, most]
        return np.where(np.isnan(limit), np.inf, limit)

    def others(d: np.ndarray, i, j) -> np.ndarray:
        return np.where(q["id"][i][:, None] == c["id"][j][None], np.inf, d)

    if not len(q["id"]) or not len(c["id"]):
        return
    scored = _scored(q, c, metric)
    if scored is None:
        pairs = _near(q, c, metric, reach, others if skip_self else None)
    else:
        pairs = _ranked(q, c, k, metric, skip_self, scored)
    for i, j, distance in pairs:
        keep = q["id"][i] != c["id"][j] if skip_self else np.ones(len(i), bool)
        i, j, distance = i[keep], j[keep], distance[keep]
        order = np.lexsort((c["id"][j], distance, i))
        i, j, distance = i[order], j[order], distance[order]
        # Tiles end within a row at times; the final choice is made by all of a query's rows together.
        first = np.searchsorted(i, i)
        near = np.arange(len(i)) - first < k
        yield pa.RecordBatch.from_arrays([pa.array(q["id"][i[near]]), pa.array(c["id"][j[near]]), pa.array(distance[near], pa.float32())], names=["query", "id", "distance"])


def exact_knn(points: DataFrame, k: int, metric: Metric = EUCLIDEAN) -> DataFrame:
    """Exact neighbours. Each task keeps k candidates a query, so the shuffle is k rows for each query and group.

    Work grows with the square of the points, as any exact search of unindexed points does; see
    :func:`approximate_knn`.
    """
    if metric.block is None:
        return brute_force(points, k, metric=metric)
    if k < 1:
        return points.sparkSession.createDataFrame([], _FOUND + ", rank int")

    def meet(a: Rows, b: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        yield from _top(a, b, k, metric, True)
        if not same:
            yield from _top(b, a, k, metric, True)

    return best(meet_all(points.select(F.col("id").cast("long").alias("id"), "item"), meet, _FOUND), k)


def all_pairs(points: DataFrame, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], column: Callable[[DataFrame], DataFrame], d: int) -> DataFrame:
    """(source, target, distance) of all pairs source < target of vectors (id, item): group against group, in blocks.

    ``distances`` gives those of two arrays of vectors of length ``d``; rows that are no such vectors are joined with all others, and
    ``column`` puts the distance to their rows (source, a, target, b). There are as many rows as pairs, but no task makes more than the square of PAIRED.

    What is written takes the disk, so rows come in an order that packs well: a group is a range of ids, each source has its targets in a
    run, and these are the same for every source. Columnar writers also judge by their first rows whether a column's values
    repeat, so a task begins with the distances that are most frequent.
    """
    schema = "source long, target long, distance double"
    points = points.select(F.col("id").cast("long").alias("id"), "item")
    usual = F.coalesce((F.size("item") == d) & ~F.exists("item", lambda x: x.isNull()), F.lit(False))

    def meet(a: Rows, b: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        a, b = ({name: x[order] for name, x in rows.items()} for rows in (a, b) for order in [np.argsort(rows["id"])])
        step = max(1, TILE // 16 // RUN)
        first = True
        for begin, at in itertools.product(range(0, len(b["id"]), RUN), range(0, len(a["id"]), step)):
            sources, targets = a["of"][at : at + step], b["of"][begin : begin + RUN]
            # Ranges are in order, but equal ids may have come into two of them.
            i, j = np.nonzero(sources[:, None] < targets[None])
            if not len(i):
                continue
            distance = distances(a["item"][at : at + step], b["item"][begin : begin + RUN])[i, j]
            if first:
                order = np.argsort(np.abs(distance - np.median(distance)), kind="stable")
                i, j, distance, first = i[order], j[order], distance[order], False
            yield pa.RecordBatch.from_arrays([pa.array(sources[i]), pa.array(targets[j]), pa.array(distance, pa.float64())], names=["source", "target", "distance"])

    ranked = number_rows(points.where(usual).withColumnRenamed("id", "of"), ["of"])
    found = meet_all(ranked, meet, schema, most=PAIRED, ranked=True)
    odd = points.where(~usual)
    if odd.isEmpty():
        return found
    of = lambda rows, end, item: rows.select(F.col("id").alias(end), F.col("item").alias(item))
    once = of(odd, "source", "a").join(of(points, "target", "b"), F.col("source") < F.col("target"))
    turned = of(points.where(usual), "source", "a").join(of(odd, "target", "b"), F.col("source") < F.col("target"))
    return found.unionByName(column(once.unionByName(turned)).select("source", "target", F.col("distance").cast("double").alias("distance")))


def summed(a: np.ndarray, b: np.ndarray, term: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Sums of ``term`` over the elements of all pairs, added up in their order, as SQL does."""
    a, b = np.ascontiguousarray(a.T, np.float64), np.ascontiguousarray(b.T, np.float64)
    out = np.zeros((a.shape[1], b.shape[1]))
    for x, y in zip(a, b, strict=True):
        out += term(x[:, None], y[None])
    return out


def search(points: DataFrame, queries: DataFrame, ef: int, metric: Metric = EUCLIDEAN, with_self: bool = True) -> DataFrame:
    """The ``ef`` nearest items of each query (id, item); with ``with_self`` a query that is itself a point comes with it.

    Queries are held, GROUP at a time, and the points stream past them.
    """
    if metric.block is None:
        return brute_force(points, ef, queries, metric, with_self)
    spark = points.sparkSession
    held = max(1, -(-queries.count() // GROUP))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // held)

    def meet(q: Rows, c: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        yield from _top(q, c, ef, metric, not with_self)

    mine = [F.col("id").cast("long").alias("id"), F.col("item")]
    own = F.pmod(F.xxhash64("id"), F.lit(held)).cast("int")
    rows = queries.select(own.alias("key0"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("key1"), F.lit(0).alias("role"), *mine)
    lots = points.select(F.explode(F.sequence(F.lit(0), F.lit(held - 1))).alias("key0"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("key1"), F.lit(1).alias("role"), *mine)
    dealt = rows.unionByName(lots).repartition(held * parts, "key0", "key1").sortWithinPartitions("key0", "key1", "role")
    return best(dealt.mapInArrow(_held_and_streamed(meet, ["id", "item"], 2, False), _FOUND), ef)


def _nearest_cells(x: np.ndarray, centres: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest centres of each vector, nearest first."""
    x, c = x.astype(np.float64), centres.astype(np.float64)
    d = (c * c).sum(1)[None] - 2 * (x @ c.T)
    if most < len(c):
        near = np.argpartition(d, most - 1, axis=1)[:, :most]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return np.argsort(d, axis=1, kind="stable")


def approximate_knn(points: DataFrame, k: int, target: float = TARGET, sample: int = SAMPLE, seed: int = 7) -> DataFrame:
    """Neighbours (Euclidean) among the points of the cells around each point.

    Up to CELLS sampled points are centres of cells; every point lies in the cell of its nearest centre
    and looks into those of its nearest few. How many that must be is measured: the exact neighbours of
    ``sample`` points are found in one pass, and so many cells are looked into that they hold the share
    ``target`` of them, whatever the number of points. Where that is over a third of all cells the
    index is no use, and the search is exact. Only centres and sample reach the driver and tasks;
    crowded cells are split into parts of at most about GROUP points.
    """
    if k < 1:
        return exact_knn(points, k)
    points = points.select(F.col("id").cast("long").alias("id"), "item")
    n = points.count()
    cells = min(CELLS, int(np.sqrt(n)))
    if cells < 8:
        return exact_knn(points, k)
    picked = _rows(points.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(cells + sample).toArrow().combine_chunks().to_batches(), ["id", "item"])
    centres = picked["item"][:cells]
    asked = {name: x[-sample:] for name, x in picked.items()}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = _rows([batch], ["id", "item"])
                place = dict(zip(own["id"].tolist(), range(len(own["id"])), strict=True))
                for found in _top(asked, own, k, EUCLIDEAN, True):
                    at = np.array([place[i] for i in found.column(1).to_pylist()], np.int64)
                    yield found.append_column("cell", pa.array(_nearest_cells(own["item"][at], centres, 1)[:, 0], pa.int32()))

    known = points.mapInArrow(look, _FOUND + ", cell int")
    order = Window.partitionBy("query").orderBy("distance", "id")
    known = known.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "cell").toArrow()
    where = {q: r for q, r in zip(asked["id"].tolist(), np.argsort(_nearest_cells(asked["item"], centres, cells), axis=1), strict=True)}
    ranks = np.sort([where[q][c] for q, c in zip(known.column(0).to_pylist(), known.column(1).to_pylist(), strict=True)])
    looked = int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1
    if 3 * looked > cells:
        log.warning("%d of %d cells would have to be looked into: the search is exact", looked, cells)
        return exact_knn(points, k)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                near = _nearest_cells(_column(part.column(1)), centres, looked)
                for r in range(looked + 1):
                    yield pa.RecordBatch.from_arrays([pa.array(near[:, max(0, r - 1)], pa.int32()), pa.array(np.full(len(near), min(r, 1)), pa.int32()), *part.columns], names=["key0", "role", "id", "item"])

    kind = points.schema["item"].dataType.simpleString()
    placed = points.mapInArrow(place, f"key0 int, role int, id long, item {kind}")
    # CELLS rows at most.
    parts = cut(placed.where("role = 0").groupBy("key0").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")))
    placed = placed.join(F.broadcast(parts), "key0")
    part = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    placed = placed.select("key0", F.explode(part).alias("key1"), "role", "id", "item")
    number = max(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * (looked + 1) // (GROUP * 10))
    dealt = placed.repartition(number, "key0", "key1").sortWithinPartitions("key0", "key1", "role")

    def meet(stored: Rows, queries: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        yield from _top(queries, stored, k, EUCLIDEAN, True)

    return best(dealt.mapInArrow(_held_and_streamed(meet, ["id", "item"], 2, False), _FOUND), k)


def similarity_join(points: DataFrame, eps: float, metric: Metric = EUCLIDEAN) -> DataFrame:
    """Pairs source < target within ``eps``: by segments for texts a few edits apart, over cells where the metric obeys the
    triangle inequality, else group against group."""
    if metric.block is None:
        right = points.select(F.col("id").alias("target"), F.col("item").alias("_b"))
        pairs = points.join(right, F.col("id") < F.col("target"))
        return pairs.select(F.col("id").alias("source"), "target", metric.column(F.col("item"), F.col("_b")).alias("distance")).where(F.col("distance") <= eps)
    from denspark.operators import cells, edits

    if metric.name == "levenshtein" and 0 <= eps <= EDITS:
        return edits.edit_join(points, int(eps))
    if metric.name in cells.METRICS:
        return cells.similarity_join(points, eps, metric).pairs

    def meet(a: Rows, b: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        for i, j, d in _near(a, b, metric, lambda w: np.full(len(w), float(eps))):
            s, t = a["id"][i], b["id"][j]
            keep = (d <= eps) & ((s < t) if same else True)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s, t)[keep]), pa.array(np.maximum(s, t)[keep]), pa.array(d[keep], pa.float32())], names=["source", "target", "distance"])

    return meet_all(points.select(F.col("id").cast("long").alias("id"), "item"), meet, "source long, target long, distance float")


def lightest_of(q: Rows, c: Rows, metric: Metric) -> Iterator[pa.RecordBatch]:
    """(tree, source, target, weight, sequence): the lightest edge from each tree of q to another tree of c."""

    def weigh(d: np.ndarray, i, j) -> np.ndarray:
        w = np.maximum(np.maximum(d, q["core"][i][:, None]), c["core"][j][None])
        return np.where(q["tree"][i][:, None] == c["tree"][j][None], np.inf, w)

    def reach(w: np.ndarray) -> np.ndarray:
        least = w.min(1)
        # Rows without another tree have no edge.
        return np.where(np.isfinite(least), least, -np.inf)

    found = []
    for i, j, d in _near(q, c, metric, reach, weigh):
        w = np.maximum(np.maximum(d, q["core"][i]), c["core"][j]).astype(np.float32)
        s, t = np.minimum(q["id"][i], c["id"][j]), np.maximum(q["id"][i], c["id"][j])
        keep = q["tree"][i] != c["tree"][j]
        rows = [x[keep] for x in (q["tree"][i], w, s, t)]
        order = np.lexsort(rows[::-1])
        rows = [x[order] for x in rows]
        first = np.concatenate([[True], rows[0][1:] != rows[0][:-1]]) if len(order) else np.zeros(0, bool)
        found.append([x[first] for x in rows])
    if found:
        tree, w, s, t = (np.concatenate([f[k] for f in found]) for k in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(tree), pa.array(s), pa.array(t), pa.array(w, pa.float32()), pa.array(np.zeros(len(s), np.int64))], names=["tree", "source", "target", "weight", "sequence"])


def lightest_edges(points: DataFrame, metric: Metric = EUCLIDEAN) -> DataFrame:
    """(tree, source, target, weight, sequence): candidates for the lightest edge that leaves each tree.

    ``points``: id, item, core, tree. A weight is the largest of distance and both core distances; each
    task gives one edge a tree and group at most. Groups meet all groups; see :mod:`cells` for bounds.
    """

    def meet(a: Rows, b: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        yield from lightest_of(a, b, metric)
        if not same:
            yield from lightest_of(b, a, metric)

    own = points.select(F.col("id").cast("long").alias("id"), "item", F.col("core").cast("float").alias("core"), F.col("tree").cast("long").alias("tree"))
    return meet_all(own, meet, "tree long, source long, target long, weight float, sequence long")


def lightest_edges_from(few: DataFrame, points: DataFrame, number: int, n: int, metric: Metric = EUCLIDEAN) -> DataFrame:
    """As :func:`lightest_edges`, from the trees of ``few`` alone: ``number`` points that a task holds, while its share of all ``n`` points streams past."""
    spark = points.sparkSession
    # The few travel to every task, together at most as many rows as twice the points where tasks are many.
    parts = max(spark.sparkContext.defaultParallelism, min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * n // max(1, number)))
    own = [F.col("id").cast("long").alias("id"), F.col("item"), F.col("core").cast("float").alias("core"), F.col("tree").cast("long").alias("tree")]
    held = few.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("key0"), F.lit(0).alias("role"), *own)
    rows = points.select(F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("key0"), F.lit(1).alias("role"), *own)

    def meet(a: Rows, b: Rows, same: bool) -> Iterator[pa.RecordBatch]:
        yield from lightest_of(a, b, metric)

    dealt = held.unionByName(rows).repartitionById(parts, "key0").sortWithinPartitions("key0", "role")
    return dealt.mapInArrow(_held_and_streamed(meet, ["id", "item", "core", "tree"], 1, False), "tree long, source long, target long, weight float, sequence long")


def adjacency(neighbours: DataFrame, m: int = 16) -> DataFrame:
    """(node, layer, neighbour): the symmetric base layer of a neighbour graph, at most 2m nearest of each node.

    A link stays if both ends keep it, so links are mutual and no degree exceeds the bound.
    """
    both = neighbours.select("query", "id", "distance").unionByName(neighbours.select(F.col("id").alias("query"), F.col("query").alias("id"), "distance")).distinct()
    kept = best(both, 2 * m)
    back = kept.select(F.col("id").alias("query"), F.col("query").alias("id"))
    return kept.join(back, ["query", "id"]).select(F.col("query").alias("node"), F.lit(0).alias("layer"), F.col("id").alias("neighbour"))
