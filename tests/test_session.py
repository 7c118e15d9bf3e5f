import pytest

from denspark import errors
from denspark.config import ClusterConfig, KnnParams
from denspark.functions.distance import ABSOLUTE
from denspark.operators import knn
from denspark.operators.density import core_distances
from denspark.streaming.session import ClusteringSession


@pytest.fixture
def session(spark, tmp_path):
    source = spark.createDataFrame([(i, float(i)) for i in range(8)], "id long, item double")
    return ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(2, params=KnnParams(2, 4)), ABSOLUTE)


def test_a_session_starts_empty_and_keeps_the_good_prefix(session):
    assert session.point_count == 0
    session.append([0, 1])
    assert session.core_distance(0) is None
    with pytest.raises(errors.ENGINE["CPU_HNSW_FAILURE"]):
        session.append([2, 0, 3])
    assert session.point_count == 3
    with pytest.raises(errors.DATA_SOURCE["OUT_OF_BOUNDS"]):
        session.append([99])
    assert session.snapshot_version == 0


def test_recomputed_cores_equal_the_full_ones(session):
    session.append([0, 1, 2, 3])
    session.recompute_core_distances()
    session.append([4, 5, 6, 7])
    session.recompute_core_distances()
    points = session.table("points")
    want = {r["id"]: r["core"] for r in core_distances(knn.brute_force(points, 4, metric=ABSOLUTE), 2, points).collect()}
    assert {i: session.core_distance(i) for i in range(8)} == want
    version = session.version
    session.recompute_core_distances()
    assert session.version == version


def test_replayed_batches_are_skipped_and_bad_rows_set_aside(session, spark):
    batch = spark.createDataFrame([(0,), (1,), (1,), (50,)], "id long")
    session.append_batch(batch, 0)
    session.append_batch(batch, 0)
    assert session.point_count == 2
    assert {k: session.metrics[k] for k in ("versions", "points", "edges", "rejects")} == {"versions": 2, "points": 2, "edges": 1, "rejects": 2}
    assert {(r["id"], r["reason"]) for r in session.table("rejects").collect()} == {(1, "DUPLICATE_NODE"), (50, "DATA_SOURCE_OUT_OF_BOUNDS")}


def test_appends_write_their_own_rows_only(session, tmp_path):
    for ids in ([0, 1], [2, 3, 4], [5]):
        session.append(ids)
        session.recompute_core_distances()
    folders = lambda name: sorted(int(x.name[2:]) for x in (tmp_path / "s" / name).iterdir())
    assert folders("points") == folders("edges") == [1, 2, 4, 6]
    assert folders("core") == [6, 7]
    assert session.spark.read.parquet(str(tmp_path / "s" / "points" / "v=4")).count() == 3
    assert session.point_count == 6
    assert session.metrics["points"] == 6


def reopened(session):
    return ClusteringSession(session.source, session.root, session.config, session.metric)


def state(session):
    return session.version, session.metrics, session.last_batch, *(sorted(map(tuple, session.table(name).collect()), key=str) for name in ("points", "edges", "core", "rejects"))


def test_a_reopened_session_goes_on(session, spark):
    session.append([0, 1, 2])
    session.recompute_core_distances()
    session.append_batch(spark.createDataFrame([(3,), (3,), (70,)], "id long"), 4)
    again = reopened(session)
    assert state(again) == state(session)
    again.append_batch(spark.createDataFrame([(4,)], "id long"), 4)
    assert again.point_count == 4
    again.append_batch(spark.createDataFrame([(4,)], "id long"), 5)
    again.recompute_core_distances()
    third = reopened(session)
    assert state(third) == state(again)
    assert third.point_count == 5 and third.core_distance(4) is not None
    with pytest.raises(errors.ENGINE["CPU_HNSW_FAILURE"]):
        third.append([4])


def test_a_second_writer_is_refused(session):
    other = reopened(session)
    session.append([0, 1])
    with pytest.raises(errors.ENGINE["SESSION_CONFLICT"]):
        other.append([2])
    assert session.point_count == 2
    assert other.reload() and other.point_count == 2
    other.append([2])
    assert reopened(session).point_count == 3
    with pytest.raises(errors.ENGINE["SESSION_CONFLICT"]):
        ClusteringSession(session.source, session.root, ClusterConfig(3), session.metric)


def test_a_failed_write_is_never_seen(session, spark, monkeypatch):
    session.append([0, 1])
    before = state(session)
    broken = spark.range(3).selectExpr("id", "raise_error('lost') as item").selectExpr("id", "cast(item as double) as item", "0 as cell")
    with pytest.raises(Exception, match="lost"):
        session._write({"points": broken})
    assert state(session) == before and state(reopened(session)) == before
    session.append([2])
    again = reopened(session)
    assert again.point_count == 3 and again.version == session.version == before[0] + 2


def test_small_folders_are_written_as_one(session, tmp_path, monkeypatch):
    monkeypatch.setattr("denspark.streaming.session.FOLDERS", 3)
    for i in range(6):
        session.append([i])
    assert session.point_count == 6 and session.metrics["points"] == 6
    assert max(len(v) for v in session._versions.values()) <= 4
    again = reopened(session)
    again.append([6])
    again.append([7])
    assert state(reopened(session)) == state(again) and again.point_count == 8
    assert len(list((tmp_path / "s" / "points").iterdir())) <= 5


def test_a_stream_goes_on_after_a_restart(session, spark, tmp_path):
    folder, checkpoint = tmp_path / "in", str(tmp_path / "c")
    folder.mkdir()

    def arrive(name, ids):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.mode("append").parquet(str(folder))

    def run(own):
        own.follow(spark.readStream.schema("id long").parquet(str(folder)), checkpoint).awaitTermination()

    arrive("a", [0, 1, 2])
    run(session)
    arrive("b", [3, 4])
    again = reopened(session)
    run(again)
    assert sorted(r["id"] for r in again.table("points").collect()) == [0, 1, 2, 3, 4]
    # Another stream begins at batch 0 again.
    arrive("c", [5])
    last = reopened(session)
    last.follow(spark.readStream.schema("id long").parquet(str(folder)), str(tmp_path / "d")).awaitTermination()
    assert sorted(r["id"] for r in last.table("points").collect()) == [0, 1, 2, 3, 4, 5]
    assert last.metrics["rejects"] == 5


def test_appends_read_the_cells_of_their_points(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(5)
    x = (rng.random((40, 2))[rng.integers(0, 40, 3000)] * 400 + rng.standard_normal((3000, 2))).astype(np.float32)
    source = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, item array<float>").repartition(4).cache()
    session = ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(3, params=KnnParams(4, 6)))
    session.append(list(range(2900)))
    assert session._indexed == 2900 and len(session._cells["count"]) == 53
    plan = session.table("points").where("cell in (3, 4)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan
    near = [int(i) for i in np.argsort(((x - x[2950]) ** 2).sum(1)) if i >= 2900][:5]
    before = session.metrics["read"]
    session.append(near)
    assert session.metrics["read"] - before < 900
    with pytest.raises(errors.ENGINE["CPU_HNSW_FAILURE"]):
        session.append(near[:1])
    again = reopened(session)
    again.append([i for i in range(2900, 3000) if i not in near])
    want = {(r["source"], r["target"]) for r in edges_of(near, x)}
    got = {(r["source"], r["target"]) for r in again.table("edges").collect()}
    assert want <= got
    again.recompute_core_distances_full()
    cores = {r["id"]: r["core"] for r in again.table("core").collect()}
    exact = {r["id"]: r["core"] for r in core_distances(knn.exact_knn(again.table("points").select("id", "item"), 6), 3).collect()}
    assert cores == exact


def edges_of(ids, x):
    """Edges of the points ``ids`` to their six nearest among those that were there with them."""
    import numpy as np

    out = []
    there = [*range(2900), *ids]
    for i in ids:
        d = ((x[there].astype(np.float64) - x[i].astype(np.float64)) ** 2).sum(1)
        order = [there[k] for k in np.lexsort((there, d)) if there[k] != i][:6]
        out += [{"source": min(i, j), "target": max(i, j)} for j in order]
    return out


def test_cells_are_made_anew_as_the_session_grows(spark, tmp_path):
    source = spark.createDataFrame([(i, [float(i % 97), float(i % 89)]) for i in range(2600)], "id long, item array<float>").cache()
    session = ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(2, params=KnnParams(2, 4)))
    session.append(list(range(60)))
    assert len(session._cells["count"]) == 7
    session.append(list(range(60, 2600)))
    assert session._indexed == 2600 and len(session._cells["count"]) == 50
    assert sum(session._cells["count"]) == session.point_count == 2600
    again = reopened(session)
    again.recompute_core_distances_full()
    exact = {r["id"]: r["core"] for r in core_distances(knn.exact_knn(source, 4), 2).collect()}
    assert {r["id"]: r["core"] for r in again.table("core").collect()} == exact


def test_each_batch_of_a_followed_stream_is_reported(session, spark, tmp_path):
    from denspark.streaming.reports import BatchReports

    for k, ids in enumerate(([0, 1, 2], [3, 60], [4])):
        spark.createDataFrame([(i,) for i in ids], "id long").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    reports = BatchReports()
    query = session.follow(stream, str(tmp_path / "c"), reports)
    query.awaitTermination()
    assert reports.wait_for(str(query.id))
    spark.streams.removeListener(reports)
    own = [r for r in reports.batches if r["rows"]]
    assert [r["batch"] for r in own] == [0, 1, 2]
    assert sum(r["observed"]["ids"]["rows"] for r in own) == 6 and max(r["observed"]["ids"]["high"] for r in own) == 60
    assert all(r["seconds"] > 0 and r["durations"] for r in own)
    assert reports.ended[str(query.id)] is None
    assert session.point_count == 5 and session.metrics["rejects"] == 1
