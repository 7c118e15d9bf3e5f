"""Labels of a session, kept up as items come.

The forest of all candidate edges is renewed from few of them: the forest before, and the edges at items that are
new or whose core distance fell since. An edge between two other items that was left out before is the heaviest on a
cycle; the cycle's edges have at most the weight they had, so it still is, and needn't be looked at. Core
distances only grow while there are too few items for all neighbours that are wanted; then all edges are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.functions.distance import Metric
from denspark.lineage import cut
from denspark.operators.density import canonical, mutual_reachability
from denspark.operators.hierarchy import check_forest, condense, numbered_labels
from denspark.operators.msf import spanning_forest
from denspark.plans.clustering import connect
from denspark.sources.readers import number_rows


@dataclass(frozen=True)
class Renewal:
    """``forest`` and ``bridges`` (source, target, distance, sequence), and what was looked at."""

    forest: DataFrame
    bridges: DataFrame | None
    changed: int
    candidates: int
    whole: bool


def moved_items(core: DataFrame, before: DataFrame) -> DataFrame:
    """(id, grew): items that are new or whose core distance isn't the one of ``before``."""
    rows = core.select("id", "core").join(before.select("id", F.col("core").alias("old")), "id", "left")
    return rows.where("old is null or old <> core").select("id", F.coalesce(F.col("core") > F.col("old"), F.lit(False)).alias("grew"))


def pending_edges(edges: DataFrame, moved: DataFrame) -> DataFrame:
    """The edges at ``moved`` items; one between two of them comes twice."""
    at = lambda end: edges.join(moved.select(F.col("id").alias(end)), end, "left_semi").select(edges.columns)
    return at("source").unionByName(at("target"))


def _lightest(edges: DataFrame) -> DataFrame:
    return canonical(edges).groupBy("source", "target").agg(F.min("distance").alias("distance"), F.min("sequence").alias("sequence"))


def _measured(pairs: DataFrame, points: DataFrame, metric: Metric) -> DataFrame:
    """Pairs of ids with their distances."""
    s, t = points.select(F.col("id").alias("source"), F.col("item").alias("a")), points.select(F.col("id").alias("target"), F.col("item").alias("b"))
    found = metric.column(F.col("a"), F.col("b")).cast("float")
    return pairs.join(s, "source").join(t, "target").select("source", "target", found.alias("distance"), F.lit(0).cast("long").alias("sequence"))


def renew(points: DataFrame, core: DataFrame, edges: DataFrame, forest: DataFrame, before: DataFrame, metric: Metric) -> Renewal:
    """The forest of ``edges`` by mutual reachability, bridged where it falls apart.

    ``forest`` and ``before`` (id, core) are the forest and the core distances of the last time.
    """
    moved = cut(moved_items(core, before))
    seen = moved.agg(F.count("*").alias("n"), F.max("grew").alias("grew")).first()
    whole = bool(seen["grew"]) or before.isEmpty()
    own = cut(_lightest(edges if whole else forest.unionByName(pending_edges(edges, moved))))
    weighted = mutual_reachability(own, core)
    linked = connect(points, core, weighted, metric)
    bridges = None
    if linked is not weighted:
        bridges = cut(_measured(linked.join(own, ["source", "target"], "left_anti").select("source", "target").distinct(), points, metric))
        own = cut(_lightest(own.unionByName(bridges)))
        weighted = mutual_reachability(own, core)
    kept = spanning_forest(weighted).select("source", "target")
    return Renewal(cut(own.join(kept, ["source", "target"], "left_semi")), bridges, seen["n"], own.count(), whole)


def forest_labels(n: int, forest: DataFrame, core: DataFrame, min_cluster_size: int, points: DataFrame) -> tuple[DataFrame, int]:
    """(id, label) and the number of clusters."""
    weighted = cut(mutual_reachability(forest, core))
    check_forest(n, weighted, min_cluster_size)
    labels, k = numbered_labels(condense(points.select("id"), weighted, min_cluster_size))
    return cut(labels), k


def matched_names(labels: DataFrame, k: int, before: DataFrame, unused: int) -> DataFrame:
    """(label, name) of the labels below ``k``: names stay with the items.

    A cluster takes the name of the one before with which it shares most items, if that one shares most items with it
    as well (of equal shares the lower name, the lower label). Others get new names from ``unused`` on, by label.
    """
    old = before.where("name is not null").select("id", "name")
    shared = cut(labels.where(F.col("label") < k).join(old, "id").groupBy("label", "name").agg(F.count("*").alias("n")))
    by_label = shared.groupBy("label").agg(F.max(F.struct("n", (-F.col("name")).alias("x")))["x"].alias("x")).select("label", (-F.col("x")).alias("name"))
    by_name = shared.groupBy("name").agg(F.max(F.struct("n", (-F.col("label")).alias("x")))["x"].alias("x")).select("name", (-F.col("x")).alias("label"))
    again = by_label.join(by_name, ["label", "name"], "left_semi")
    new = number_rows(labels.where(F.col("label") < k).select("label").distinct().join(again, "label", "left_anti"), ["label"])
    return again.unionByName(new.select("label", (F.col("id") + unused).alias("name")))
