"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.lineage import cut

#: Edges between different labels that one task may join: what the clustering engine gives for ``finish``.
FINISH = 200_000


class Union:
    """Sets of keys, joined by size with path halving."""

    def __init__(self):
        self.up: dict = {}
        self.size: dict = {}

    def find(self, x):
        up = self.up
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size.get(a, 1) < self.size.get(b, 1):
            a, b = b, a
        self.up[b] = a
        self.size[a] = self.size.get(a, 1) + self.size.get(b, 1)
        return True


def _joined(key: list[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """(key, x, p): the ends of a bounded number of edges, and the smallest that each is joined with."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sets = Union()
        for pdf in batches:
            of = pdf[key[0]].tolist() if key else [None] * len(pdf)
            for k, a, b in zip(of, pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                sets.join((k, a), (k, b))
        least: dict = {}
        for x in sets.up:
            top = sets.find(x)
            least[top] = min(least.get(top, x), x)
        rows = [(*x[:1][: len(key)], x[1], least[sets.find(x)][1]) for x in sets.up]
        yield pd.DataFrame(rows, columns=[*key, "x", "p"])

    return run


def connected_components(edges: DataFrame, within: str | None = None, finish: int = 0) -> DataFrame:
    """(source, target) -> (node, component), the smallest node of each component; nodes without an edge aren't listed.

    With ``within``, a column of the edges, the graphs of its values are apart, and it comes first in the result.

    Every round hooks each label to its smallest neighbour, follows that twice, and replaces the
    edges by those between the new labels, so their number shrinks geometrically. Edges are
    combined before each shuffle; nothing but a count reaches the driver. When no more than ``finish`` edges
    between different labels are left, one task joins them.
    """
    key = [within] if within else []
    pairs = edges.select(*key, F.col("source").alias("a"), F.col("target").alias("b"))
    nodes = pairs.select(*key, F.col("a").alias("node")).union(pairs.select(*key, "b")).distinct()
    labels = nodes.withColumn("component", F.col("node"))
    live = cut(pairs.where("a <> b").select(*key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while (left := live.limit(finish + 1).count()) > finish:
        both = live.union(live.select(*key, F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(*key, "a").agg(F.min("b").alias("b")).select(*key, F.col("a").alias("x"), F.least("a", "b").alias("p"))
        for _ in range(2):
            up = hook.select(*key, F.col("x").alias("p"), F.col("p").alias("q"))
            hook = hook.join(up, [*key, "p"], "left").select(*key, "x", F.coalesce("q", "p").alias("p"))
        hook = cut(hook)
        labels = cut(labels.join(hook.withColumnRenamed("x", "component"), [*key, "component"], "left").select(*key, "node", F.coalesce("p", "component").alias("component")))
        above_a = hook.select(*key, F.col("x").alias("a"), F.col("p").alias("pa"))
        above_b = hook.select(*key, F.col("x").alias("b"), F.col("p").alias("pb"))
        live = live.join(above_a, [*key, "a"]).join(above_b, [*key, "b"]).where("pa <> pb")
        live = cut(live.select(*key, F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not left:
        return labels
    kind = {f.name: f.dataType.simpleString() for f in live.schema}
    ends = live.coalesce(1).mapInPandas(_joined(key), ", ".join([*(f"{k} {kind[k]}" for k in key), f"x {kind['a']}", f"p {kind['a']}"]))
    return cut(labels.join(ends.withColumnRenamed("x", "component"), [*key, "component"], "left").select(*key, "node", F.coalesce("p", "component").alias("component")))


def chains(points: DataFrame, eps: float) -> DataFrame:
    """(source, target) whose components are those of all pairs of numbers (id, item) that differ by at most ``eps``; every point has an edge, if only with itself.

    Numbers are put into bins of half of ``eps``: those of a bin are all within reach of its first, and two bins are linked if
    the upper's least number is within reach of the lower's greatest. Only bins are compared, so there are about as many edges as points.
    Numbers so large that bins would be rounded (doubles have 16 values at most within ``eps`` there) are joined by range, each different one once.
    """
    size, far = F.abs("item"), eps * 2.0**49
    rows = points.withColumn("bin", F.when(size < far, F.floor(F.col("item") / (eps / 2))))
    bins = cut(rows.where("bin is not null").groupBy("bin").agg(F.min(F.struct("item", "id")).alias("low"), F.max("item").alias("high")))
    inner = rows.join(bins.select("bin", F.col("low.id").alias("first")), "bin", "left").select(F.coalesce("first", "id").alias("source"), F.col("id").alias("target"))
    above = bins.select(F.col("low.id").alias("target"), F.col("low.item").alias("least"), F.explode(F.array(*[F.col("bin") - k for k in (1, 2, 3)])).alias("bin"))
    across = bins.join(above, "bin").where(F.col("least") - F.col("high") <= eps).select(F.col("low.id").alias("source"), "target")
    large = points.where((size >= far / 2) & (size < float("inf")))
    values = cut(large.groupBy("item").agg(F.min("id").alias("id")))
    equal = large.join(values.withColumnRenamed("id", "first"), "item").select(F.col("first").alias("source"), F.col("id").alias("target"))
    x, y = values.select(F.col("id").alias("source"), F.col("item").alias("x")), values.select(F.col("id").alias("target"), F.col("item").alias("y"))
    apart = x.join(y, F.col("y").between(F.col("x"), F.col("x") + eps) & (F.col("y") - F.col("x") <= eps)).select("source", "target")
    return inner.unionByName(across).unionByName(equal).unionByName(apart)
