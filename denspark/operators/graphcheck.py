"""Invariants of an index given as tables: nodes (node, level), adjacency (node, layer, neighbour), entry (node, level).

Each check returns its violations; :func:`collect` unites them and :func:`check` raises at the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.config import KnnParams
from denspark.errors import INDEX
from denspark.lineage import cut


def layer_consistency(nodes: DataFrame, adjacency: DataFrame) -> DataFrame:
    """Links to nodes that don't exist or don't reach the link's layer."""
    target = nodes.select(F.col("node").alias("neighbour"), "level")
    return adjacency.join(target, "neighbour", "left").where(F.col("level").isNull() | (F.col("level") < F.col("layer"))).select("node", "layer", "neighbour")


def degree_bounds(adjacency: DataFrame, params: KnnParams) -> DataFrame:
    """Nodes with more links in a layer than its bound."""
    bound = F.when(F.col("layer") == 0, 2 * params.m).otherwise(params.m)
    return adjacency.groupBy("node", "layer").agg(F.count("*").alias("degree")).where(F.col("degree") > bound)


def bidirectional(adjacency: DataFrame) -> DataFrame:
    """Links whose reverse is missing in their layer."""
    back = adjacency.select(F.col("neighbour").alias("node"), "layer", F.col("node").alias("neighbour"))
    return adjacency.join(back, ["node", "layer", "neighbour"], "left_anti")


def self_loops(adjacency: DataFrame) -> DataFrame:
    return adjacency.where(F.col("node") == F.col("neighbour"))


def reachable(adjacency: DataFrame, entry: DataFrame) -> DataFrame:
    """Nodes that can be reached from the entry over any layer: one frontier join a step."""
    links = cut(adjacency.select("node", "neighbour").distinct())
    seen = cut(entry.select("node").distinct())
    frontier = seen
    while not frontier.isEmpty():
        step = links.join(frontier, "node").select(F.col("neighbour").alias("node")).distinct()
        frontier = cut(step.join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def unreachable(nodes: DataFrame, adjacency: DataFrame, entry: DataFrame) -> DataFrame:
    """Nodes that can't be reached; all of them without an entry."""
    return nodes.select("node").join(reachable(adjacency, entry), "node", "left_anti")


def collect(nodes: DataFrame, adjacency: DataFrame, entry: DataFrame, params: KnnParams) -> DataFrame:
    """(invariant, node) of all violations."""
    found = {
        "layer_consistency": layer_consistency(nodes, adjacency),
        "degree_bounds": degree_bounds(adjacency, params),
        "bidirectional": bidirectional(adjacency),
        "self_loops": self_loops(adjacency),
        "reachability": unreachable(nodes, adjacency, entry),
        "entry": entry.select("node", F.col("level").alias("l")).join(nodes, "node", "left").where(F.col("level").isNull() | (F.col("level") < F.col("l"))),
    }
    out = None
    for name, rows in found.items():
        part = rows.select(F.lit(name).alias("invariant"), "node")
        out = part if out is None else out.unionByName(part)
    return out


def check(nodes: DataFrame, adjacency: DataFrame, entry: DataFrame, params: KnnParams) -> None:
    bad = collect(nodes, adjacency, entry, params).limit(1).collect()
    if bad:
        raise INDEX["GRAPH_INVARIANT_VIOLATION"](f"{bad[0]['invariant']} at node {bad[0]['node']}")
