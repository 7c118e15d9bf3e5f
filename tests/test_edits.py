"""Edit distances in blocks, and joins and searches of texts, against all pairs."""

import random

import numpy as np
import pytest

from denspark.functions import distance
from denspark.functions.distance import LEVENSHTEIN
from denspark.operators import cells, edits, knn


def slow(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def words(seed, n, most, letters="abcd é日😀"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("most", "pairs"), [(9, 1 << 16), (70, 40), (200, 7)])
def test_block_equals_the_table(monkeypatch, most, pairs):
    monkeypatch.setattr(distance, "PAIRS", pairs)
    a = [*words(most, 14, most), "", "x" * 64, "x" * 65, "xy" * 64]
    b = [*words(most + 1, 11, most), "", "x" * 64, "yx" * 64]
    got = LEVENSHTEIN.block(np.array(a, object), np.array(b, object))
    assert got.tolist() == [[slow(x, y) for y in b] for x in a]
    assert LEVENSHTEIN.block(np.array([], object), np.array(b, object)).shape == (0, len(b))


def edited(seed, n, most=24):
    rng = random.Random(seed)
    out = words(seed, n // 3, most, "abcdef ")
    while len(out) < n:
        own = list(rng.choice(out))
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(own))
            own[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "z"])
        out.append("".join(own))
    return [*out, None, "", ""]


@pytest.mark.parametrize("most", [0, 1, 2, 4])
def test_edit_join(spark, most):
    rows = list(enumerate(edited(most, 120)))
    points = spark.createDataFrame(rows, "id long, item string").repartition(3)
    got = [tuple(r) for r in edits.edit_join(points, most).collect()]
    want = {(i, j, float(slow(x, y))) for i, x in rows for j, y in rows if i < j and x is not None and y is not None and slow(x, y) <= most}
    assert len(got) == len(set(got))
    assert set(got) == want


@pytest.mark.parametrize("most", [0, 1, 3])
def test_edit_search(spark, most):
    rows, asked = list(enumerate(edited(7, 90))), [(100 + i, t) for i, t in enumerate(edited(8, 30) + edited(7, 12))]
    points, queries = (spark.createDataFrame(x, "id long, item string").repartition(2) for x in (rows, asked))
    got = [tuple(r) for r in edits.edit_search(points, queries, most).collect()]
    want = {(q, i, float(slow(x, y))) for q, x in asked for i, y in rows if x is not None and y is not None and slow(x, y) <= most}
    assert len(got) == len(set(got))
    assert set(got) == want


def test_no_row_cross_join(spark):
    points = spark.createDataFrame([(1, "abcdefgh"), (2, "abcdefgx")], "id long, item string")
    for frame in (edits.edit_join(points, 2), edits.edit_search(points, points, 2), knn.exact_knn(points, 1, LEVENSHTEIN)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert edits.edit_join(points.limit(0), 2).count() == 0 and edits.edit_search(points, points.limit(0), 2).count() == 0


def test_text_neighbours_and_cells(spark):
    texts = [t for t in edited(3, 90) if t is not None]
    points = spark.createDataFrame(list(enumerate(texts)), "id long, item string").repartition(3)
    fields = ["query", "id", "distance", "rank"]
    assert sorted(map(tuple, knn.exact_knn(points, 4, LEVENSHTEIN).select(fields).collect())) == sorted(map(tuple, knn.brute_force(points, 4, metric=LEVENSHTEIN).select(fields).collect()))
    got = {tuple(r) for r in cells.similarity_join(points, 3.0, LEVENSHTEIN, cells=6).pairs.collect()}
    assert got == {(i, j, float(slow(x, y))) for i, x in enumerate(texts) for j, y in enumerate(texts) if i < j and slow(x, y) <= 3}
    known = points.selectExpr("id", "item", "cast(id % 3 as float) as core", "id % 7 as tree")
    best = lambda edges: {r["tree"]: (r["e"]["weight"], r["e"]["source"], r["e"]["target"]) for r in edges.selectExpr("tree", "struct(weight, source, target) as e").groupBy("tree").agg({"e": "min"}).withColumnRenamed("min(e)", "e").collect()}
    assert best(cells.lightest_bridges(known, LEVENSHTEIN).edges) == best(knn.lightest_edges(known, LEVENSHTEIN))
