import pandas as pd
import pytest

from denspark import errors
from denspark.config import ClusterConfig, KnnParams, RefreshPolicy
from denspark.functions.distance import ABSOLUTE, EUCLIDEAN, LEVENSHTEIN
from denspark.operators.density import mutual_reachability
from denspark.operators.hierarchy import labels_from_forest
from denspark.operators.msf import spanning_forest
from denspark.plans.clustering import cluster
from denspark.sources.synthetic import blobs
from denspark.streaming.refresh import matched_names
from denspark.streaming.session import ClusteringSession


def rows(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()))


def full_run(session):
    """Forest and labels of all the session's edges at its present core distances, without what was known before."""
    weighted = mutual_reachability(session.table("edges"), session.table("core").select("id", "core"))
    forest = spanning_forest(weighted)
    return forest, labels_from_forest(session.point_count, forest, session.config.min_cluster_size, session.table("points"))


def same_groups(a, b):
    return len(set(zip(a, b, strict=True))) == len(set(a)) == len(set(b))


def test_every_refresh_equals_a_full_run_over_the_same_edges(spark, tmp_path):
    points = blobs(spark, 120, 3, 4, separation=4.0, seed=3).select("id", "item").cache()
    session = ClusteringSession(points, str(tmp_path / "s"), ClusterConfig(4, params=KnnParams(4, 8)), EUCLIDEAN)
    shares = []
    for number, part in enumerate(("id < 60", "id between 60 and 63", "id > 63")):
        session.append_batch(points.where(part), number)
        labels = session.refresh()
        forest, want = full_run(session)
        assert rows(labels, "id", "label") == rows(want, "id", "label")
        assert rows(session.table("forest"), "source", "target") == rows(forest, "source", "target")
        assert session.snapshot_version == number + 1
        seen = session.refreshed
        assert seen["items"] == session.point_count and seen["edges"] == session.table("edges").count() and seen["whole"] == (number == 0)
        shares.append(seen["taken"] / seen["edges"])
    assert shares[0] == 1 and shares[1] < 0.6  # the last batch is half of all and moves nearly every item
    # Blobs that are well apart come out as in a run over all points at once.
    once = dict(rows(cluster(points, session.config)))
    mine = dict(rows(labels, "id", "label"))
    assert same_groups([once[i] for i in range(120)], [mine[i] for i in range(120)])
    version = session.version
    assert rows(session.refresh()) == rows(labels) and session.version == version


def test_core_distances_that_grow_make_all_edges_count_again(spark, tmp_path):
    source = spark.createDataFrame([(i, float(x)) for i, x in enumerate((0, 1, 50, 51, 52, 2, 3, 53, 4))], "id long, item double")
    session = ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(3, params=KnnParams(2, 3)), ABSOLUTE)
    session.append([0, 1, 5])
    session.refresh()
    session.append([2, 3])  # the third neighbour of 0 is at 50 now; it had two before
    labels = session.refresh()
    assert session.refreshed["whole"]
    session.append([4, 6, 7, 8])
    labels = session.refresh()
    assert rows(labels, "id", "label") == rows(full_run(session)[1])
    assert len({r["label"] for r in labels.collect() if r["name"] is not None}) == 2


def test_a_batch_far_from_all_others_is_bridged(spark, tmp_path):
    source = spark.createDataFrame([(i, float(i % 6) + 1000 * (i // 6)) for i in range(12)], "id long, item double")
    session = ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(2, params=KnnParams(2, 3)), ABSOLUTE)
    for number in range(2):
        session.append_batch(source.where(f"id div 6 = {number}"), number)
        labels = session.refresh()
        assert session.table("forest").count() == session.point_count - 1
        assert session.refreshed["bridges"] == (number > 0)
    assert (5, 6) in rows(session.table("edges"), "source", "target")
    assert rows(labels, "id", "label") == rows(full_run(session)[1])


def test_names_last_while_labels_move(spark, tmp_path):
    values = [*range(100, 110), *range(200, 210), *range(10)]
    source = spark.createDataFrame([(i, float(x)) for i, x in enumerate(values)], "id long, item double")
    session = ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(3, params=KnnParams(2, 4)), ABSOLUTE)
    session.append(list(range(20)))
    before = {r["id"]: r["name"] for r in session.refresh().collect()}
    assert len(set(before.values())) == 2 and set(before.values()) == {0, 1}
    again = ClusteringSession(source, session.root, session.config, session.metric)
    assert rows(again.table("labels")) == rows(session.table("labels")) and again.refreshed == session.refreshed
    again.append(list(range(20, 30)))
    after = {r["id"]: r["name"] for r in again.refresh().collect()}
    assert {i: after[i] for i in before} == before
    assert {after[i] for i in range(20, 30)} == {2}
    assert again.refreshed["names"] == 3 and again.snapshot_version == 2


def test_matched_names_by_hand(spark):
    before = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 8), (5, 8), (6, None), (9, 9)], "id long, name long")
    # 7 is split (label 1 has most of it), 8 and 7 partly merge into label 1, label 0 is new, 3 is noise.
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 1), (5, 3), (6, 0), (9, 3)], "id long, label long")
    assert rows(matched_names(labels, 3, before, 20)) == [(0, 20), (1, 7), (2, 21)]
    assert rows(matched_names(labels, 0, before, 20)) == []
    assert rows(matched_names(labels, 3, before.limit(0), 0)) == [(0, 0), (1, 1), (2, 2)]


def test_the_policy_refreshes_after_enough_items(spark, tmp_path):
    source = spark.createDataFrame([(i, f"word{i % 3}{'x' * (i % 2)}") for i in range(6)], "id long, item string")
    config = ClusterConfig(2, params=KnnParams(2, 4), refresh=RefreshPolicy(4))
    session = ClusteringSession(source, str(tmp_path / "s"), config, LEVENSHTEIN)
    seen = []
    for number in range(6):
        session.append_batch(source.where(f"id = {number}"), number)
        seen.append(session.snapshot_version)
    assert seen == [0, 0, 0, 1, 1, 1]
    assert session.table("labels").count() == 4


def test_too_few_items_are_refused(spark, tmp_path):
    source = spark.createDataFrame([(0, 0.0), (1, 1.0)], "id long, item double")
    session = ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(3), ABSOLUTE)
    with pytest.raises(errors.ENGINE["EMPTY_SOURCE"]):
        session.refresh()
    session.append([0, 1])
    with pytest.raises(errors.ENGINE["INSUFFICIENT_ITEMS"]):
        session.refresh()
    assert session.snapshot_version == 0 and session.table("labels").count() == 0


def test_a_log_from_before_there_were_labels_can_be_opened(spark, tmp_path):
    import json

    source = spark.createDataFrame(pd.DataFrame({"id": range(6), "item": [0.0, 1, 2, 9, 10, 11]}))
    session = ClusteringSession(source, str(tmp_path / "s"), ClusterConfig(2), ABSOLUTE)
    session.append([0, 1, 2, 3, 4, 5])
    log = tmp_path / "s" / "log" / f"{session.version}.json"
    record = json.loads(log.read_text())
    del record["refreshed"], record["folders"]["labels"], record["folders"]["forest"]
    log.write_text(json.dumps(record))
    (log.parent / f".{log.name}.crc").unlink(missing_ok=True)
    again = ClusteringSession(source, session.root, session.config, session.metric)
    assert again.refreshed == {} and again.refresh().count() == 6 and again.snapshot_version == 1
