"""Core distances, mutual reachability and the order of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from denspark.sources.readers import number_rows

#: Edges of a stretch whose windows one task makes.
STRETCH = 100_000


def core_distances(neighbours: DataFrame, min_cluster_size: int, points: DataFrame | None = None) -> DataFrame:
    """(id, core): distance of the ``min_cluster_size``-th neighbour, else of the farthest one, else 0."""
    at = F.max(F.when(F.col("rank") == min_cluster_size, F.col("distance")))
    core = neighbours.groupBy(F.col("query").alias("id")).agg(F.coalesce(at, F.max("distance")).alias("core"))
    if points is None:
        return core
    return points.select("id").join(core, "id", "left").select("id", F.coalesce("core", F.lit(0.0).cast("float")).alias("core"))


def canonical(edges: DataFrame) -> DataFrame:
    """Edges with source below target, without loops."""
    rest = [c for c in edges.columns if c not in ("source", "target")]
    turned = edges.where("source <> target").select(F.least("source", "target").alias("s"), F.greatest("source", "target").alias("t"), *rest)
    return turned.select(F.col("s").alias("source"), F.col("t").alias("target"), *rest)


def candidate_edges(neighbours: DataFrame) -> DataFrame:
    """(source, target, distance, sequence): each neighbour pair once; the sequence is the pair's place by (source, target).

    Sequences only break ties between equal edges, which the pair's order does as well.
    """
    pairs = canonical(neighbours.select(F.col("query").alias("source"), F.col("id").alias("target"), "distance"))
    return pairs.groupBy("source", "target").agg(F.min("distance").alias("distance")).withColumn("sequence", F.lit(0).cast("long"))


def mutual_reachability(edges: DataFrame, core: DataFrame) -> DataFrame:
    """``weight``: the largest of an edge's distance and its ends' core distances."""
    s, t = core.select(F.col("id").alias("source"), F.col("core").alias("cs")), core.select(F.col("id").alias("target"), F.col("core").alias("ct"))
    out = edges.join(s, "source").join(t, "target")
    return out.select("source", "target", F.greatest("distance", "cs", "ct").alias("weight"), "sequence")


def ordered(edges: DataFrame, weight: str = "distance") -> DataFrame:
    """Edges in the strict order (weight, source, target, sequence)."""
    return edges.orderBy(weight, "source", "target", "sequence")


def harvest_order(edges: DataFrame) -> DataFrame:
    """Edges by sequence first, then by the strict order."""
    return edges.orderBy("sequence", "distance", "source", "target")


def edge_windows(edges: DataFrame, size: int, key: str | None = None) -> DataFrame:
    """Every run of ``size`` consecutive edges in harvest order (within ``key``, if given) as an array.

    Without a key edges are numbered, and cut into stretches that also hold the ``size - 1`` edges after them.
    """
    fields = ["source", "target", "distance", "sequence"]
    if key:
        own = edges.withColumns({"part": F.col(key), "at": F.struct("sequence", "distance", "source", "target"), "begins": F.lit(True)})
    else:
        rows = number_rows(edges.select(*fields), ["sequence", "distance", "source", "target"]).withColumnRenamed("id", "at")
        stretch = max(STRETCH, size)
        part = F.floor(F.col("at") / stretch)
        own = rows.withColumns({"part": part, "begins": F.lit(True)})
        after = rows.where(((F.col("at") % stretch) < size - 1) & (part > 0))
        own = own.unionByName(after.withColumns({"part": part - 1, "begins": F.lit(False)}))
    order = Window.partitionBy("part").orderBy("at")
    run = F.collect_list(F.struct(*fields)).over(order.rowsBetween(0, size - 1))
    return own.select("begins", run.alias("edges")).where(F.col("begins") & (F.size("edges") == size)).select("edges")


def dedup(edges: DataFrame) -> DataFrame:
    """Of edges equal in (weight, source, target), the one with the lowest sequence."""
    return edges.groupBy("weight", "source", "target").agg(F.min("sequence").alias("sequence")).select("source", "target", "weight", "sequence")
