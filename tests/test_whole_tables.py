"""Queries whose work must grow with the table: no pairs as rows, exact results all the same."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from denspark import errors, queries
from denspark.operators import components, knn
from denspark.operators.components import connected_components
from denspark.plans import clustering
from test_clustering import forest_of


def grid(spark, n, seed=5):
    """Points of few different places, so that there are equal points and equal distances."""
    xy = np.random.default_rng(seed).integers(0, 9, (n, 2)).astype(np.float32)
    return xy, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(xy)], "id long, item array<float>")


@pytest.mark.parametrize("many", [10, 1000])
def test_the_forest_of_all_pairs_needs_no_pairs(spark, monkeypatch, many):
    xy, points = grid(spark, 90)
    monkeypatch.setattr(clustering, "MANY", many)
    monkeypatch.setattr(knn, "similarity_join", None)
    pairs = [(i, j, float(np.float32(np.sqrt(((xy[i].astype(float) - xy[j]) ** 2).sum()))), 0) for i in range(90) for j in range(i)]
    monkeypatch.setattr(queries, "_suppliers", lambda *_: points)
    got = [tuple(r) for r in queries.msf_supplier(spark, "").collect()]
    assert got == [(s, t, w) for s, t, w, _ in forest_of(pairs, 90)]


def test_points_without_finite_distances_are_refused(spark):
    points = spark.createDataFrame([(0, [0.0]), (1, [float("inf")])], "id long, item array<float>")
    with pytest.raises(errors.DensparkError):
        clustering.complete_forest(points).collect()


@pytest.mark.parametrize("finish", [0, 3, 1000])
def test_components_may_be_finished_by_one_task(spark, finish):
    rng = np.random.default_rng(3)
    edges = [(int(k), int(a), int(b)) for k, a, b in zip(rng.integers(0, 2, 60), rng.integers(0, 60, 60), rng.integers(0, 60, 60), strict=True)]
    df = spark.createDataFrame(edges, "part long, source long, target long")
    want = connected_components(df, "part").collect()
    assert {tuple(r) for r in connected_components(df, "part", finish).collect()} == {tuple(r) for r in want}
    whole = connected_components(df.drop("part"), finish=finish).collect()
    assert {tuple(r) for r in whole} == {tuple(r) for r in connected_components(df.drop("part")).collect()}
    assert components.FINISH > 1000


def test_components_of_numbers_need_no_pairs(spark):
    values = [-0.5, 99.5, 199.5, 300.0, 400.0, 500.0000001, -1e-17, None, float("nan"), float("inf"), float("inf"), 1e17, 1e17 + 96, 1e17 + 208, 1e300, 1e300, None, 700.0]
    points = spark.createDataFrame(list(enumerate(values)), "id long, item double")
    links = components.chains(points, 100.0)
    assert spark.range(5000).select("id", F.lit(7.0).alias("item")).transform(lambda p: components.chains(p, 100.0)).count() == 5000
    found = dict(tuple(r) for r in connected_components(links, finish=100).collect())
    at = dict(enumerate(values))
    near = [(a, b) for a in at for b in at if None not in (at[a], at[b]) and abs(at[a] - at[b]) <= 100]
    assert found == {i: min([i, *(j for j in at if (i, j) in reach)]) for reach in [closed(near)] for i in at}


def closed(pairs):
    while True:
        more = {(a, d) for a, b in pairs for c, d in pairs if b == c} | set(pairs)
        if len(more) == len(set(pairs)):
            return more
        pairs = more


def test_all_pairs_in_blocks_keep_rows_that_are_no_vectors(spark, monkeypatch):
    monkeypatch.setattr(knn, "PAIRED", 7)
    v = np.random.default_rng(2).normal(size=(20, 3)).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(20, None), (21, [1.0, None, 2.0]), (22, [1.0])]
    points = spark.createDataFrame(rows, "id long, item array<float>")
    monkeypatch.setattr(queries, "_vectors", lambda *_: points)
    got = {(r["source"], r["target"]): r["distance"] for r in queries.euclidean_pairs(spark, "").collect()}
    assert sorted(got) == [(i, j) for i in range(23) for j in range(i + 1, 23)]
    assert all((got[k] is None) == (k[1] >= 20) for k in got)
    assert all(got[i, j] == float(np.float32(np.sqrt(((v[i].astype(float) - v[j]) ** 2).sum()))) for i, j in got if j < 20)
    monkeypatch.setattr(queries, "_vectors", lambda *_: points.where("id < 20"))
    plan = queries.cosine_pairs(spark, "")._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_components_of_all_edges_are_found_once(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(10 * (i // 2) ** 2 + i % 2)]) for i in range(24)], "id long, item array<float>")
    core = points.select("id", F.lit(0.0).cast("float").alias("core"))
    edges = spark.createDataFrame([(i, i + 1, 1.0, 0) for i in range(0, 24, 2)], "source long, target long, weight float, sequence long")
    sizes = []
    monkeypatch.setattr(clustering, "connected_components", lambda e, **k: sizes.append(e.count()) or connected_components(e, **k))
    linked = clustering.connect(points, core, edges, clustering.EUCLIDEAN)
    assert linked.count() == 23 and connected_components(linked, finish=100).select("component").distinct().count() == 1
    # Once all 12 edges, then the bridges of each round.
    assert sizes[0] == 12 and sum(sizes[1:]) == 11


def columns_of(folder):
    """Bytes a row of each column of the written rows, and how its values were encoded."""
    size, kinds, n = {}, {}, 0
    for path in folder.glob("*.parquet"):
        data = pq.ParquetFile(path).metadata
        for g in range(data.num_row_groups):
            n += data.row_group(g).num_rows
            for c in range(data.num_columns):
                column = data.row_group(g).column(c)
                size[column.path_in_schema] = size.get(column.path_in_schema, 0) + column.total_compressed_size
                kinds.setdefault(column.path_in_schema, set()).update(column.encodings)
    return {name: x / n for name, x in size.items()}, kinds


@pytest.mark.parametrize("name", ["cosine_pairs", "euclidean_pairs"])
def test_all_pairs_take_little_disk(spark, monkeypatch, tmp_path, name):
    rng = np.random.default_rng(8)
    v, ids = rng.normal(size=(2000, 64)).astype(np.float32), rng.permutation(10**6)[:2000]
    points = spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v, strict=True)], "id long, item array<float>")
    monkeypatch.setattr(queries, "_vectors", lambda *_: points)
    queries.QUERIES[name](spark, "").write.parquet(str(tmp_path / "out"))
    size, kinds = columns_of(tmp_path / "out")
    # Ends come in runs that repeat, and rounded distances are kept once and referred to.
    assert size["source"] + size["target"] < 1.2
    assert name == "euclidean_pairs" or "PLAIN" not in kinds["distance"]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2000 * 1999 // 2


def test_equal_ids_are_no_pair(spark, monkeypatch):
    monkeypatch.setattr(knn, "PAIRED", 3)
    ids = [0, 1, 1, 1, 1, 1, 1, 2]
    points = spark.createDataFrame([(i, [float(k), 1.0]) for k, i in enumerate(ids)], "id long, item array<float>")
    monkeypatch.setattr(queries, "_vectors", lambda *_: points)
    got = sorted((r["source"], r["target"], round(r["distance"])) for r in queries.euclidean_pairs(spark, "").collect())
    assert got == sorted((a, b, abs(i - j)) for i, a in enumerate(ids) for j, b in enumerate(ids) if a < b)


def test_a_pair_of_groups_is_a_task_of_its_own(spark):
    points = spark.range(4000).select("id", F.array(F.rand(1).cast("float")).alias("item"))

    def meet(a, b, same):
        yield pa.RecordBatch.from_arrays([pa.array([int(a["id"].sum() * 7 + b["id"].sum())])], names=["met"])

    dealt = knn.meet_all(points, meet, "met long", most=500).select(F.spark_partition_id().alias("task")).groupBy("task").count()
    assert [tuple(r) for r in dealt.select("count").distinct().collect()] == [(1,)] and dealt.count() == 36
