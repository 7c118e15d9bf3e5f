"""Nearest neighbours by one product a tile, against all distances by definition."""

import numpy as np
import pytest

from denspark import queries
from denspark.functions.distance import COSINE, EUCLIDEAN
from denspark.operators import descent, knn

RNG = np.random.default_rng(5)
VECTORS = {
    "spread": RNG.standard_normal((900, 40)),
    "far from 0": RNG.standard_normal((500, 40)) + 1e4,
    "equal ones": np.repeat(RNG.standard_normal((12, 64)), 40, 0),
    "whole numbers": RNG.integers(0, 3, (700, 20)),
    "tiny": RNG.standard_normal((300, 40)) * 1e-25,
    "huge": RNG.standard_normal((300, 40)) * 1e18,
    "flat": np.stack([RNG.choice(RNG.uniform(-999, 9999, 60), 800), RNG.integers(0, 25, 800)], 1),
    "few": RNG.standard_normal((4, 64)),
}


def by_definition(ids, x, k, metric, with_self):
    x = x.astype(np.float64)
    out = {}
    for i, v in zip(ids.tolist(), x, strict=True):
        if metric is EUCLIDEAN:
            d = np.sqrt(((x - v) ** 2).sum(1)).astype(np.float32)
        else:
            d = np.float32(1) - np.clip((np.einsum("ij,j->i", x, v) / np.linalg.norm(x, axis=1) / np.linalg.norm(v)).astype(np.float32), -1, 1)
        out[i] = sorted((float(e), j) for e, j in zip(d, ids.tolist(), strict=True) if with_self or j != i)[:k]
    return out


@pytest.mark.parametrize("metric", [EUCLIDEAN, COSINE], ids=lambda m: m.name)
@pytest.mark.parametrize("name", VECTORS)
def test_ranked_by_one_product(monkeypatch, name, metric):
    def blocks_of_distances(*_):
        raise AssertionError("vectors with finite squares need no block of distances")

    monkeypatch.setattr(knn, "_near", blocks_of_distances)
    monkeypatch.setattr(knn, "TILE", 50_000)
    x = VECTORS[name].astype(np.float32)
    ids = RNG.permutation(len(x)).astype(np.int64)
    rows = {"id": ids, "item": x}
    for k, with_self in ((1, True), (10, False), (64, False)):
        found = {i: set() for i in ids.tolist()}
        for batch in knn._top(rows, rows, k, metric, not with_self):
            for q, i, d in zip(*(batch.column(c).to_pylist() for c in ("query", "id", "distance")), strict=True):
                found[q].add((d, i))
        got, want = {q: sorted(f)[:k] for q, f in found.items()}, by_definition(ids, x, k, metric, with_self)
        if metric is EUCLIDEAN:
            assert got == want
        else:  # sums in another order may differ in the last place
            assert all(np.allclose([d for d, _ in got[q]], [d for d, _ in want[q]], atol=1.3e-7, rtol=0) for q in want)


def test_vectors_without_structure_are_compared_in_full(spark, monkeypatch):
    monkeypatch.setattr(descent, "FEW", 0)
    n = 1200
    x = np.random.default_rng(2).random((n, 48)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, item array<float>").repartition(3).cache()
    graph = descent.neighbour_graph(points, 10, target=0.999)
    # The lists of the first length are held against exact ones once, then all pairs are met in blocks: no lists of twice the length.
    assert graph.recall == 1.0 and graph.rounds <= descent.ROUNDS
    assert graph.compared >= n * (n - 1) // 2
    assert {tuple(r) for r in graph.neighbours.collect()} == {tuple(r) for r in knn.exact_knn(points, 10).collect()}


def test_lists_too_short_for_a_trial_are_not_refined_for_all(spark, monkeypatch):
    monkeypatch.setattr(descent, "FEW", 0)
    monkeypatch.setattr(descent, "TRIED", 600, raising=False)
    monkeypatch.setattr(descent, "MANY", 2, raising=False)
    x = np.random.default_rng(2).random((1200, 48)).astype(np.float32)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, item array<float>").repartition(3).cache()
    sizes, searches = [], []
    first, exact = descent._first_lists, knn.exact_knn
    monkeypatch.setattr(descent, "_first_lists", lambda p, n, *a: sizes.append(n) or first(p, n, *a))
    for module in (descent, knn):
        monkeypatch.setattr(module, "exact_knn", lambda *a: searches.append(a) or exact(*a))
    monkeypatch.setattr(queries, "_vectors", lambda *_: points)
    monkeypatch.setattr(queries, "neighbour_graph", lambda p, k: descent.neighbour_graph(p, k, target=0.999))
    row = queries.approximate_recall(spark, "").first()
    # Only the trial is refined, and all pairs are met once, for the graph and for what it is held against.
    assert sizes == [600] and len(searches) == 1
    assert (row["hits"], row["total"], row["fraction"]) == (12000, 12000, 1.0) and row["compared"] > 1200 * 1199 // 2
    assert {tuple(r) for r in descent.neighbour_graph(points, 10, target=0.999).neighbours.collect()} == {tuple(r) for r in exact(points, 10).collect()}
