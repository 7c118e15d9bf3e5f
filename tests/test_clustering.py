import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from denspark import errors
from denspark.config import ClusterConfig, KnnParams
from denspark.functions.distance import ABSOLUTE, LEVENSHTEIN
from denspark.operators import density, graphcheck, hierarchy, knn, quality
from denspark.operators.hierarchy import condense, dendrogram, labels_from_forest
from denspark.operators.msf import kruskal, spanning_forest
from denspark.plans.clustering import check_labels, cluster
from denspark.sources import synthetic


def numbers(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, item double")


def labels(df):
    return [r["label"] for r in df.orderBy("id").collect()]


def forest_of(edges, n):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    out = []
    for w, s, t, q in sorted((e[2], min(e[:2]), max(e[:2]), e[3]) for e in edges if e[0] != e[1]):
        a, b = find(s), find(t)
        if a != b:
            up[a] = b
            out.append((s, t, w, q))
    return out


def top_down(n, edges, least):
    """Labels by the definition: split from the top, condense, keep the most stable, number by splits."""
    children, size, parent = {}, dict.fromkeys(range(n), 1), {}
    top = list(range(n))

    def find(x):
        while x in parent:
            x = parent[x]
        return x

    for k, (s, t, w, _) in enumerate(edges):
        a, b = find(s), find(t)
        children[n + k] = (a, b, w)
        size[n + k] = size[a] + size[b]
        parent[a] = parent[b] = n + k
    top = max(size, key=lambda x: (size[x], x))

    def points(x):
        return [x] if x < n else points(children[x][0]) + points(children[x][1])

    clusters = [{"up": None, "birth": 0.0, "s": 0.0, "kids": [], "points": []}]

    def walk(x, c):
        if x < n:
            clusters[c]["points"].append(x)
            return
        a, b, w = children[x]
        d = np.inf if w == 0 else 1 / w
        if size[a] >= least and size[b] >= least:
            ids = []
            for y in (a, b):
                clusters[c]["s"] += (d - clusters[c]["birth"]) * size[y]
                clusters.append({"up": c, "birth": d, "s": 0.0, "kids": [], "points": []})
                ids.append(len(clusters) - 1)
            clusters[c]["kids"] = ids
            for y, i in zip((a, b), ids, strict=True):
                walk(y, i)
            return
        for y in (a, b):
            if size[y] >= least:
                walk(y, c)
            else:
                clusters[c]["points"] += points(y)
                clusters[c]["s"] += (d - clusters[c]["birth"]) * size[y]

    walk(top, 0)
    best = {}

    def choose(c):
        kids = clusters[c]["kids"]
        below = [choose(k) for k in kids]
        total = sum(b[0] for b in below)
        if kids and total > clusters[c]["s"]:
            best[c] = (total, [x for b in below for x in b[1]])
        else:
            best[c] = (clusters[c]["s"], [c])
        return best[c]

    chosen = sorted(choose(0)[1])
    out = [len(chosen)] * n
    for i, c in enumerate(clusters):
        x = i
        while x is not None and x not in chosen:
            x = clusters[x]["up"]
        if x is not None:
            for p in c["points"]:
                out[p] = chosen.index(x)
    return out


@pytest.mark.parametrize(("values", "want"), [([0, 0.1, 0.2, 10, 10.1, 10.2], [0, 0, 0, 1, 1, 1]), ([0, 0, 0, 5, 5, 5], [0, 0, 0, 1, 1, 1]), ([0, 0.1, 0.2, 10, 10.1, 10.2, 100], [0, 0, 0, 1, 1, 1, 2])])
def test_two_groups_and_an_outlier(spark, values, want):
    assert labels(cluster(numbers(spark, values), ClusterConfig(2), ABSOLUTE)) == want


def test_text_clusters(spark):
    points = spark.createDataFrame(list(enumerate(["alpha", "alpho", "alphi", "omega", "omego", "omegi"])), "id long, item string")
    assert labels(cluster(points, ClusterConfig(2), LEVENSHTEIN)) == [0, 0, 0, 1, 1, 1]


def test_checks_come_in_order(spark):
    with pytest.raises(errors.ENGINE["EMPTY_SOURCE"]):
        cluster(numbers(spark, []))
    with pytest.raises(errors.ENGINE["INSUFFICIENT_ITEMS"]):
        cluster(numbers(spark, [1, 2]), ClusterConfig(3, strategy="gpu"))
    with pytest.raises(errors.ENGINE["BACKEND_UNAVAILABLE"]):
        cluster(numbers(spark, [1, 2, 3]), ClusterConfig(3, strategy="gpu", max_bytes=1))
    with pytest.raises(errors.ENGINE["MEMORY_LIMIT_EXCEEDED"]):
        cluster(numbers(spark, [1, 2, 3]), ClusterConfig(3, max_bytes=1))


@pytest.mark.parametrize("least", [2, 4, 5])
def test_labels_follow_the_definition(spark, least):
    rng = np.random.default_rng(least)
    n = 60
    x = np.concatenate([rng.normal(c, s, (15, 2)) for c, s in ((0, 0.3), (3, 0.5), (7, 1.0), (3.5, 3.0))])
    edges = [(i, j, float(np.float32(np.linalg.norm(x[i] - x[j]))), 0) for i, j in itertools.combinations(range(n), 2)]
    tree = forest_of(edges, n)
    df = spark.createDataFrame(tree, "source long, target long, weight float, sequence long")
    assert labels(labels_from_forest(n, df, least)) == top_down(n, tree, least)
    # Small chunks give the same hierarchy.
    sizes = sorted(r["size"] for r in condense(spark.range(n), df, least, chunk=20).clusters.collect())
    assert sizes == sorted(r["size"] for r in condense(spark.range(n), df, least).clusters.collect())


@pytest.mark.parametrize("least", [1, 3])
def test_segments_change_nothing(spark, least):
    rng = np.random.default_rng(least)
    n = 60
    # Random trees with ties, zero weights, and long chains of small clusters.
    edges = [(int(rng.integers(max(0, i - 4), i)), i, float(np.float32(rng.choice([0, 1, 2, 3, rng.random() * 4]))), 0) for i in range(1, n) if i % 25]
    df = spark.createDataFrame(edges, "source long, target long, weight float, sequence long").coalesce(1).cache()
    points = spark.range(n)

    def all_of(tree):
        clusters = {r["cluster"]: tuple(r) for r in tree.clusters.select("cluster", "parent", "birth", "size", "kept", "side", "step").collect()}
        return clusters, {r["id"]: r["cluster"] for r in tree.members.collect()}

    assert all_of(condense(points, df, least)) == all_of(condense(points, df, least, chunk=15))
    if least == 1:
        order = ["node", "left", "right", "weight", "size"]
        assert sorted(map(tuple, dendrogram(n, df).select(*order).collect())) == sorted(map(tuple, dendrogram(n, df, chunk=15).select(*order).collect()))


def test_rounds_decide_as_one_task(spark):
    rng = np.random.default_rng(5)
    rows, open_, number = [(1, None, 0.0, 9.0, 0)], [1], 2
    # A binary tree: a spine of 12 splits, and bushes beside it; some stabilities are infinite or no numbers.
    for k in range(22):
        at = open_.pop() if k < 12 else open_.pop(int(rng.integers(0, len(open_))))
        for side in (0, 1):
            value = float(rng.choice([0.5, 1.0, 2.0, 4.0, 8.0, float("inf"), float("nan")], p=[0.2, 0.2, 0.2, 0.15, 0.15, 0.05, 0.05]))
            rows.append((number, at, 1.0, value, side))
            open_.append(number)
            number += 1
    clusters = spark.createDataFrame([(c, p, b, s, 1, d) for c, p, b, s, d in rows], "cluster long, parent long, birth double, stability double, size long, side int").coalesce(1).cache()
    best = {r["cluster"]: (r["best"], r["splits"]) for r in hierarchy._contracted(clusters).collect()}
    want = hierarchy._best(clusters.toPandas())
    assert len(best) == len(rows)
    for c, value, splits in want.itertuples(index=False):
        assert best[c] == (pytest.approx(value, nan_ok=True), splits)
    steps = {r["cluster"]: (r["kept"], r["step"]) for r in hierarchy.decide(clusters).collect()}
    assert steps[1][1] == 0
    # Splits in order: left and right of a split, then those below the left, then those below the right.
    kids, places = {}, {}
    for c, p, _, _, d in rows[1:]:
        kids.setdefault(p, {})[d] = c

    def walk(c):
        if c in kids:
            places[c] = len(places)
            walk(kids[c][0])
            walk(kids[c][1])

    walk(1)
    found = {r["cluster"]: r["above"] for r in hierarchy.selected(hierarchy.decide(clusters)).collect()}
    assert all(found[c] == places[p] for c, p, *_ in rows[1:])


def test_all_noise_and_bad_forests(spark):
    none = spark.createDataFrame([], "source long, target long, weight float, sequence long")
    assert labels(labels_from_forest(4, none, 3)) == [0, 0, 0, 0]
    for n, least, weight, code in ((0, 1, 1.0, "EMPTY_DATASET"), (2, 3, 1.0, "MIN_CLUSTER_SIZE_TOO_LARGE"), (2, 1, -1.0, "INVALID_EDGE_WEIGHT")):
        with pytest.raises(errors.HIERARCHY[code]):
            labels_from_forest(n, spark.createDataFrame([(0, 1, weight, 0)], none.schema), least)


def test_dendrogram_merges_in_order(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, 0), (2, 3, 2.0, 0), (1, 2, 3.0, 0)], "source long, target long, weight float, sequence long")
    rows = [tuple(r) for r in dendrogram(4, edges).orderBy("node").collect()]
    assert rows == [(4, 0, 1, 1.0, 2), (5, 2, 3, 2.0, 2), (6, 4, 5, 3.0, 4)]


EDGE = "source long, target long, weight float, sequence long"


def test_forest_of_unique_weights(spark):
    edges = spark.createDataFrame([(0, 1, 1.0, 0), (1, 2, 2.0, 1), (2, 3, 3.0, 2), (0, 2, 6.0, 3), (0, 3, 10.0, 4)], EDGE)
    found = kruskal(4, edges)
    assert [(r["source"], r["target"]) for r in found.edges.collect()] == [(0, 1), (1, 2), (2, 3)]
    assert found.is_tree


def test_forest_keeps_the_lowest_sequence_and_drops_loops(spark):
    found = kruskal(2, spark.createDataFrame([(1, 0, 1.0, 7), (0, 1, 1.0, 3), (0, 0, 0.0, 1)], EDGE))
    assert [tuple(r) for r in found.edges.collect()] == [(0, 1, 1.0, 3)]
    assert kruskal(2, spark.createDataFrame([(0, 0, 1.0, 0)], EDGE)).component_count == 2
    with pytest.raises(errors.FOREST["INVALID_NODE_ID"]):
        kruskal(2, spark.createDataFrame([(0, 2, 1.0, 0)], EDGE))
    with pytest.raises(errors.FOREST["NON_FINITE_WEIGHT"]):
        kruskal(2, spark.createDataFrame([(0, 0, float("nan"), 0)], EDGE))


@pytest.mark.parametrize("seed", [1, 2])
def test_rounds_give_the_same_forest_as_one_task(spark, seed):
    rng = np.random.default_rng(seed)
    edges = [(int(a), int(b), float(w), i) for i, (a, b, w) in enumerate(zip(rng.integers(0, 40, 150), rng.integers(0, 40, 150), rng.integers(1, 6, 150), strict=True))]
    df = spark.createDataFrame(edges, EDGE)
    want = sorted(forest_of(edges, 40), key=lambda e: (e[2], e[0], e[1]))
    for finish in (5, 1000):
        assert sorted((tuple(r) for r in spanning_forest(df, finish).collect()), key=lambda e: (e[2], e[0], e[1])) == [tuple(e) for e in want]


def test_neighbours_agree_with_brute_force(spark, monkeypatch):
    points = synthetic.uniform(spark, 70, 3).cache()
    want = {tuple(r) for r in knn.brute_force(points, 4).collect()}
    assert {tuple(r) for r in knn.exact_knn(points, 4).collect()} == want
    monkeypatch.setattr(knn, "GROUP", 9)
    assert {tuple(r) for r in knn.exact_knn(points, 4).collect()} == want
    assert {tuple(r) for r in knn.search(points, points.where("id < 30"), 4, with_self=False).collect()} == {r for r in want if r[0] < 30}
    assert knn.exact_knn(points, 0).count() == 0


def test_ties_and_equal_points(spark, monkeypatch):
    monkeypatch.setattr(knn, "GROUP", 11)
    rows = [(i, [float(i % 3), 1e3 + float(i % 2)]) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, item array<float>").cache()
    assert {tuple(r) for r in knn.exact_knn(points, 6).collect()} == {tuple(r) for r in knn.brute_force(points, 6).collect()}
    near = {tuple(r) for r in knn.similarity_join(points, 1.0).collect()}
    assert near == {(a, b, float(np.float32(np.hypot(x[0] - y[0], x[1] - y[1])))) for (a, x), (b, y) in itertools.combinations(rows, 2) if np.hypot(x[0] - y[0], x[1] - y[1]) <= 1}


def test_default_recall(spark):
    rng = np.random.default_rng(3)
    for n, dimension, clusters in ((600, 4, 1), (3000, 24, 40)):
        centres = rng.normal(0, 4, (clusters, dimension))
        x = (centres[rng.integers(0, clusters, n)] + rng.normal(0, 1, (n, dimension))).astype(np.float32)
        points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, item array<float>").cache()
        found = quality.total_recall(quality.recall(knn.exact_knn(points, 10), knn.approximate_knn(points, 10), 10)).first()
        assert found["fraction"] >= 0.9
        assert knn.approximate_knn(points, 10).count() == 10 * n


def test_approximate_clusters(spark):
    points = synthetic.blobs(spark, 400, 4, clusters=4).cache()
    row = quality.compare(cluster(points.select("id", "item"), ClusterConfig(5, approximate=True)), points.select("id", "label")).first()
    assert row["ari"] > 0.95


def test_core_distances_fall_back(spark):
    points = numbers(spark, [0, 1, 3])
    near = knn.brute_force(points, 5, metric=ABSOLUTE)
    core = {r["id"]: r["core"] for r in density.core_distances(near, 2, points).collect()}
    assert core == {0: 3.0, 1: 2.0, 2: 3.0}
    assert {r["core"] for r in density.core_distances(near, 9, points).collect()} == {3.0, 2.0}
    assert density.core_distances(knn.brute_force(numbers(spark, [5]), 2, metric=ABSOLUTE), 2, numbers(spark, [5])).first()["core"] == 0.0


def test_edge_order_and_windows(spark):
    edges = spark.createDataFrame([(0, 1, 2.0, 1), (1, 2, 1.0, 1), (0, 2, 9.0, 0)], "source long, target long, distance float, sequence long")
    assert [r["distance"] for r in density.harvest_order(edges).collect()] == [9.0, 1.0, 2.0]
    assert [r["distance"] for r in density.ordered(edges).collect()] == [1.0, 2.0, 9.0]
    assert density.edge_windows(edges, 2).count() == 2


@pytest.mark.parametrize(("a", "b", "ari", "nmi"), [([0, 0, 1, 1], [1, 1, 0, 0], 1, 1), ([0, 0, 0], [0, 0, 0], 1, 1), ([0, 1, 2], [0, 1, 2], 1, 1), ([0, 0, 0, 0], [0, 0, 1, 1], 0, 0), ([0], [5], 1, 1)])
def test_agreement(spark, a, b, ari, nmi):
    row = quality.scores(spark.createDataFrame(list(zip(a, b, strict=True)), "left long, right long")).first()
    assert (row["ari"], row["nmi"]) == (pytest.approx(ari), pytest.approx(nmi))


def test_labelings_of_different_items_are_an_error(spark):
    a = spark.createDataFrame([(0, 0), (1, 0)], "id long, label long")
    with pytest.raises(errors.LABELS["LENGTH_MISMATCH"]):
        quality.compare(a, a.where("id = 0"))


def test_recall(spark):
    rows = lambda ids: spark.createDataFrame([(0, i, k + 1) for k, i in enumerate(ids)], "query long, id long, rank int")
    assert tuple(quality.recall(rows([0, 1, 2]), rows([0, 2, 5]), 3).first())[1:] == (2, 3)
    assert tuple(quality.recall(rows([0]), rows([]), 3).first())[1:] == (0, 0)


@pytest.mark.parametrize(("values", "code"), [([1], "MISSING_ZERO"), ([0, 2], "GAP"), ([0, 0, 2], "DUPLICATE"), ([0, (1 << 63) - 1], "OVERFLOW")])
def test_bad_labels(spark, values, code):
    with pytest.raises(errors.LABELS[code]):
        check_labels(spark.createDataFrame([(v,) for v in values], "label long"))


def test_good_labels(spark):
    assert check_labels(spark.createDataFrame([(1,), (0,), (1,)], "label long")) == 2
    assert check_labels(spark.createDataFrame([], "label long")) == 0


def test_graph_checks(spark):
    points = synthetic.uniform(spark, 40, 2).cache()
    links = knn.adjacency(knn.exact_knn(points, 6), 4).cache()
    nodes = points.select(F.col("id").alias("node"), F.lit(0).alias("level"))
    entry = nodes.where("node = 0")
    params = KnnParams(4, 8)
    kinds = {r["invariant"] for r in graphcheck.collect(nodes, links, entry, params).collect()}
    assert kinds <= {"reachability"}
    broken = links.unionByName(spark.createDataFrame([(0, 0, 999), (1, 0, 1)], links.schema))
    kinds = {r["invariant"] for r in graphcheck.collect(nodes, broken, entry, params).collect()}
    assert {"layer_consistency", "bidirectional", "self_loops"} <= kinds
    with pytest.raises(errors.INDEX["GRAPH_INVARIANT_VIOLATION"]):
        graphcheck.check(nodes, broken, entry, params)


def test_blobs_are_found_again(spark):
    points = synthetic.blobs(spark, 160, 4, clusters=4).cache()
    row = quality.compare(cluster(points.select("id", "item")), points.select("id", "label")).first()
    assert row["ari"] > 0.95
    assert row["nmi"] > 0.95
