"""Incremental session: appended items, their candidate edges and core distances, as versioned tables.

Points are kept by cells (one partition each, :mod:`denspark.operators.cells`), so that an append reads the cells that
its points lie in or must look into, and no others; ``metrics["read"]`` counts their points. Cells are made anew when there are
``GROWTH`` times as many points as when they were made. Metrics without the triangle inequality search all points.

State lives in ``root``. A version adds a folder with its own rows to ``points``, ``edges`` and
``rejects``, and replaces ``core`` (a few bytes an item). ``log/<version>.json`` says which folders make up a
version, which batches of which stream it holds and what was counted. A writer first claims the next
version's log file, which only one can create, then writes folders, then the file's content: readers
see whole versions only, a write that failed leaves a claim without content that nobody reads, and a
second writer is refused. A session that is opened on a folder with a log goes on from its last whole version.

Replaced folders are deleted one version later. Tables of over ``FOLDERS`` small folders are written as one.
``metrics`` counts what the writes of all versions held.

Labels change by :meth:`ClusteringSession.refresh` only, called by hand or after every ``refresh.every_n`` new items:
the forest is renewed from the edges that can matter (:mod:`denspark.streaming.refresh`), ``snapshot_version`` goes up
by one, and ``labels`` has each item's label and the lasting name of its cluster (null: noise).
"""

from __future__ import annotations

import json

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from denspark.config import ClusterConfig
from denspark.errors import DATA_SOURCE, ENGINE
from denspark.functions.distance import EUCLIDEAN, Metric
from denspark.functions.scalar import effective_ef
from denspark.lineage import cut
from denspark.operators import cells
from denspark.operators.density import candidate_edges, core_distances
from denspark.operators.knn import GROUP, search
from denspark.streaming.refresh import forest_labels, matched_names, moved_items, renew
from denspark.streaming.reports import BatchReports

#: Folders of a table that are left as they are, log files that are kept, and growth after which cells are made anew.
FOLDERS, KEPT, GROWTH = 20, 50, 4
#: Names of clusters that are sent to all tasks; more are joined.
NAMES = 1_000_000


class ClusteringSession:
    """Append-only clustering state over ``source`` (id, item); goes on from what ``root`` holds."""

    def __init__(self, source: DataFrame, root: str, config: ClusterConfig | None = None, metric: Metric = EUCLIDEAN):
        self.config = config or ClusterConfig()
        if self.config.strategy == "gpu":
            raise ENGINE["BACKEND_UNAVAILABLE"]("sessions run on CPUs")
        self.spark: SparkSession = source.sparkSession
        self.source, self.root, self.metric = source, root.rstrip("/"), metric
        item = source.schema["item"].dataType.simpleString()
        self._schemas = {"points": f"id long, item {item}, cell int", "centres": f"cell int, item {item}", "edges": "source long, target long, distance float, sequence long", "core": "id long, core float, dirty boolean", "rejects": "id long, reason string", "forest": "source long, target long, distance float, sequence long", "labels": "id long, label long, name long, core float"}
        self._kind = {"item": item, "metric": metric.name, "min_cluster_size": self.config.min_cluster_size}
        self._start({"version": 0, "batches": {}, "folders": {name: [] for name in self._schemas}, "dying": [], "metrics": dict.fromkeys(("versions", "points", "edges", "rejects", "cores", "read"), 0), "snapshot": 0, "cells": {"radius": [], "count": []}, "indexed": 0, "refreshed": {}})
        if not self.reload():
            self._write({k: self.spark.createDataFrame([], v) for k, v in self._schemas.items()})

    def _start(self, record: dict) -> None:
        self.version, self.snapshot_version = record["version"], record["snapshot"]
        self._versions, self._batches, self._dying = {name: record["folders"].get(name, []) for name in self._schemas}, record["batches"], record["dying"]
        #: What the last refresh looked at: items, changed ones, edges taken of all edges, bridges, clusters, names so far; empty before the first.
        self.refreshed = record.get("refreshed", {})
        self.metrics, self._cells, self._indexed = record["metrics"], record["cells"], record["indexed"]
        self._claimed, self._centres = self.version, None

    @property
    def last_batch(self) -> int:
        """Number of the last batch that was appended without the name of a stream; -1: none."""
        return self._batches.get("", -1)

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _log(self, version: int) -> str:
        return f"{self.root}/log/{version}.json"

    def _logged(self) -> list[int]:
        """Versions that were claimed, highest first."""
        fs, at = self._fs(f"{self.root}/log")
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted((int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()), reverse=True)

    def _record(self, version: int) -> dict | None:
        """What the log says of a version; None if its write didn't end."""
        rows = self.spark.read.text(self._log(version), wholetext=True).collect()
        try:
            return json.loads(rows[0][0]) if rows else None
        except ValueError:
            return None

    def reload(self) -> bool:
        """Goes to the last whole version in the log, whoever wrote it; False if there is none."""
        claims = self._logged()
        record = next((r for r in map(self._record, claims) if r is not None), None)
        if record is None:
            self._claimed = max([self.version, *claims])
            return False
        if record["kind"] != self._kind:
            raise ENGINE["SESSION_CONFLICT"](f"{self.root} holds a session of {record['kind']}, not of {self._kind}")
        self._start(record)
        self._claimed = claims[0]
        return True

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v={version}"

    def _claim(self) -> int:
        """The next version's number, which no other writer can have."""
        version = self._claimed + 1
        fs, at = self._fs(self._log(version))
        try:
            fs.create(at, False).close()
        except Py4JJavaError as e:
            if not fs.exists(at):
                raise
            raise ENGINE["SESSION_CONFLICT"](f"version {version} of {self.root} has another writer") from e
        self._claimed = version
        return version

    def _write(self, tables: dict[str, DataFrame], source: str | None = None, batch: int = -1, whole: tuple[str, ...] = ("core",), index: cells.Index | None = None, read: int = 0, refreshed: dict | None = None) -> None:
        """Writes the next version's new rows (all rows of the tables in ``whole``), then its log; rows are counted as they are written."""
        version, seen = self._claim(), {}
        for name, df in tables.items():
            seen[name] = Observation()
            writer = df.observe(seen[name], F.count(F.lit(1)).alias("n")).write.mode("overwrite")
            (writer.partitionBy("cell") if name == "points" else writer).parquet(self._path(name, version))
        folders = {k: list(v) for k, v in self._versions.items()}
        replaced, metrics = [], dict(self.metrics)
        for name in tables:
            if name in whole:
                replaced += [[name, v] for v in folders[name]]
                folders[name] = []
            folders[name].append(version)
            if name in metrics and name not in whole or name == "core":
                metrics["cores" if name == "core" else name] += seen[name].get["n"]
        metrics["versions"] += 1
        metrics["read"] += read
        known = self._cells if index is None else {"radius": index.radius.tolist(), "count": index.count.tolist()}
        indexed = int(sum(known["count"])) if "centres" in tables else self._indexed
        batches = self._batches if source is None else self._batches | {source: batch}
        record = {"version": version, "batches": batches, "folders": folders, "dying": replaced, "metrics": metrics, "snapshot": self.snapshot_version + (refreshed is not None), "cells": known, "indexed": indexed, "refreshed": self.refreshed if refreshed is None else refreshed}
        fs, at = self._fs(self._log(version))
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(record | {"kind": self._kind}).encode()))
        out.close()
        gone = [self._path(name, v) for name, v in self._dying] + ([self._log(version - KEPT)] if version > KEPT else [])
        self._start(record)
        for path in gone:
            fs, at = self._fs(path)
            fs.delete(at, True)

    def compact(self) -> None:
        """Writes each table of several folders as one; readers of the version before keep theirs until the next write."""
        many = [name for name, v in self._versions.items() if len(v) > 1]
        parts = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        if many:
            self._write({name: self._by_cell(self.table(name), self._index()) if name == "points" and self._by_cells else self.table(name).coalesce(parts) for name in many}, whole=tuple(many))

    def table(self, name: str) -> DataFrame:
        """points, edges, core, rejects, forest or labels as of the last version."""
        if not self._versions[name]:
            return self.spark.createDataFrame([], self._schemas[name])
        rows = self.spark.read.schema(self._schemas[name] + ", v int").option("basePath", f"{self.root}/{name}")
        return rows.parquet(*[self._path(name, v) for v in self._versions[name]]).drop("v")

    @property
    def point_count(self) -> int:
        return self.table("points").count()

    @property
    def _by_cells(self) -> bool:
        return self.metric.name in cells.METRICS

    def _index(self) -> cells.Index | None:
        """The cells of the last version; None as long as there are no points."""
        if not self._by_cells or not self._cells["count"]:
            return None
        if self._centres is None:
            rows = self.table("centres").orderBy("cell").toArrow()  # CELLS rows at most
            self._centres = cells._column(rows.column("item").combine_chunks())
        return cells.Index(self._centres, np.array(self._cells["radius"]), np.array(self._cells["count"], np.int64))

    def _split(self, ids: DataFrame) -> DataFrame:
        """(at, id, item, cell, far, reason) of the rows to append; reason is null for good ones.

        An item that is there already lies in the cell that its source row falls into, so only these cells are read.
        """
        rows, index = ids.join(self.source, "id", "left").select("at", "id", "item"), self._index()
        again = F.col("at") > F.min("at").over(Window.partitionBy("id"))
        points = self.table("points")
        if index is not None:
            rows = cut(rows)
            own = cut(cells.placed(rows.where("item is not null").select("id", "item").dropDuplicates(["id"]), index.centres, self.metric))
            touched = [r["cell"] for r in own.select("cell").distinct().collect()]
            points = points.where(F.col("cell").isin(touched))
            rows = rows.join(own.select("id", "cell", "far"), "id", "left")
        else:
            rows = rows.withColumns({"cell": F.lit(0), "far": F.lit(0.0)})
        rows = rows.join(points.select("id", F.lit(1).alias("known")), "id", "left")
        reason = F.when(F.col("item").isNull(), "DATA_SOURCE_OUT_OF_BOUNDS").when(F.col("known").isNotNull() | again, "DUPLICATE_NODE")
        return rows.withColumn("reason", reason).select("at", "id", "item", "cell", "far", "reason")

    def _near(self, queries: DataFrame, k: int, index: cells.Index | None, new: DataFrame | None = None) -> tuple[DataFrame, int]:
        """The k nearest of each query among all points and ``new``, and how many stored points were read for it."""
        old = self.table("points")
        points = old if new is None else old.unionByName(new.select(*old.columns))
        if index is None:
            return search(points.select("id", "item"), queries, k, self.metric, with_self=False), self.metrics["points"]
        found, read = cells.nearest_in_cells(lambda own: points.where(F.col("cell").isin(own)), index, queries, k, self.metric)
        return found, int(index.count[read].sum())

    def _insert(self, new: DataFrame, rejects: DataFrame, source: str | None = None, batch: int = -1) -> None:
        """``new``: id, item, cell, far."""
        new = cut(new)
        added = new.count()
        n = self.metrics["points"] + added
        index = self._index()
        begins = self._by_cells and index is None and added > 0
        if begins:
            index = cells.index_of(new, added)
            new = cut(cells.placed(new, index.centres, self.metric))
        index = None if index is None else index.grown(new)
        near, read = self._near(new.select("id", "item"), effective_ef(n, self.config.min_cluster_size, self.config.params.ef_construction), index, new)
        # Each has a new end, so none is known.
        edges = candidate_edges(near)
        dirty = new.select("id", F.lit(None).cast("float").alias("core"), F.lit(True).alias("dirty"))
        tables = {"points": self._by_cell(new.select("id", "item", "cell"), index), "edges": edges, "core": self.table("core").unionByName(dirty), "rejects": rejects}
        if begins:
            tables["centres"] = self._centre_rows(index)
        self._write(tables, source, batch, index=index, read=read)
        if index is not None and n > GROWTH * max(self._indexed, 250):
            self.reindex()
        if max(len(v) for v in self._versions.values()) > FOLDERS:
            self.compact()
        every = self.config.refresh.every_n
        if every is not None and n >= max(self.config.min_cluster_size, self.refreshed.get("items", 0) + every):
            self.refresh()

    def _by_cell(self, points: DataFrame, index: cells.Index | None) -> DataFrame:
        """Points of a cell come together, GROUP in a task about, so that each cell is a file or two however many tasks there are."""
        if index is None:
            return points
        lots = [int(x) for x in -(-np.maximum(index.count, 1) // GROUP)]
        lot = F.pmod(F.xxhash64("id"), F.element_at(F.lit(lots).cast("array<int>"), F.col("cell") + 1))
        return points.repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "cell", lot)

    def _centre_rows(self, index: cells.Index) -> DataFrame:
        values = [x.tolist() if hasattr(x, "tolist") else x for x in index.centres]
        return self.spark.createDataFrame(list(enumerate(values)), self._schemas["centres"])

    def reindex(self) -> None:
        """Cells for as many points as there are now; all points are written anew, by cell."""
        points = self.table("points").select("id", "item")
        index = cells.index_of(points, self.metrics["points"])
        rows = cut(cells.placed(points, index.centres, self.metric))
        index = index.grown(rows)
        self._write({"points": self._by_cell(rows.select("id", "item", "cell"), index), "centres": self._centre_rows(index)}, whole=("points", "centres"), index=index)

    def append(self, ids: list[int]) -> None:
        """Appends items in order. The first bad id stops the rest and raises; those before it stay."""
        rows = self._split(self.spark.createDataFrame(list(enumerate(ids)), "at long, id long")).cache()
        bad = rows.where("reason is not null").orderBy("at").limit(1).collect()
        good = rows.where("reason is null")
        if bad:
            good = good.where(F.col("at") < bad[0]["at"])
        self._insert(good.select("id", "item", "cell", "far"), self.spark.createDataFrame([], self._schemas["rejects"]))
        rows.unpersist()
        if bad and bad[0]["reason"] == "DUPLICATE_NODE":
            raise ENGINE["CPU_HNSW_FAILURE"](f"item {bad[0]['id']} is there already")
        if bad:
            raise DATA_SOURCE["OUT_OF_BOUNDS"](f"no item {bad[0]['id']}")

    def append_batch(self, batch: DataFrame, batch_id: int, stream: str = "") -> None:
        """For ``foreachBatch``: appends column ``id``; bad rows go to ``rejects``, a batch of the stream that is replayed is skipped."""
        if batch_id <= self._batches.get(stream, -1):
            return
        rows = self._split(batch.select(F.monotonically_increasing_id().alias("at"), F.col("id").cast("long").alias("id"))).cache()
        self._insert(rows.where("reason is null").select("id", "item", "cell", "far"), rows.where("reason is not null").select("id", "reason"), stream, batch_id)
        rows.unpersist()

    def follow(self, stream: DataFrame, checkpoint: str, reports: BatchReports | None = None):
        """Starts a streaming query that appends the ids of ``stream``; with the same checkpoint it goes on where it ended.

        ``reports`` gets rows and times of each batch, and the aggregates ``ids`` (rows, low, high) that are observed on it.
        """
        if reports is not None:
            self.spark.streams.addListener(reports)
            stream = stream.observe("ids", F.count(F.lit(1)).alias("rows"), F.min("id").alias("low"), F.max("id").alias("high"))
        return stream.writeStream.foreachBatch(lambda batch, number: self.append_batch(batch, number, checkpoint)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def _cores(self, queries: DataFrame) -> DataFrame:
        k = effective_ef(self.metrics["points"], self.config.min_cluster_size, self.config.params.ef_construction)
        return self._near(queries.select("id", "item"), max(1, k), self._index())[0]

    def _store(self, fresh: DataFrame) -> None:
        kept = self.table("core").join(fresh, "id", "left_anti")
        done = fresh.select("id", "core", F.lit(False).alias("dirty"))
        self._write({"core": kept.unionByName(done)})

    def recompute_core_distances(self) -> None:
        """Core distances of new items and of older ones among their neighbours; nothing is written if nothing is new."""
        new = cut(self.table("core").where("dirty").select("id").join(self.table("points"), "id").select("id", "item"))
        if new.isEmpty():
            return
        near = self._cores(new)
        touched = cut(self.recompute_targets(new, near).join(self.table("points"), "id").select("id", "item"))
        # The neighbours of new items are known by now.
        if not touched.isEmpty():
            near = near.unionByName(self._cores(touched))
        self._store(core_distances(near, self.config.min_cluster_size, new.unionByName(touched)))

    @staticmethod
    def recompute_targets(new: DataFrame, neighbours: DataFrame) -> DataFrame:
        """(id) of neighbours that aren't new themselves."""
        return neighbours.select("id").distinct().join(new.select("id"), "id", "left_anti")

    def recompute_core_distances_full(self) -> None:
        """Core distances of every item."""
        points = self.table("points")
        self._store(core_distances(self._cores(points), self.config.min_cluster_size, points))

    def refresh(self) -> DataFrame:
        """(id, label, name) of all items, as a run over all the session's edges gives them; also kept as ``labels``.

        Core distances are recomputed first. Without new items, nothing is written.
        """
        n, size = self.metrics["points"], self.config.min_cluster_size
        if n == 0:
            raise ENGINE["EMPTY_SOURCE"]("no items")
        if n < size:
            raise ENGINE["INSUFFICIENT_ITEMS"](f"{n} items, {size} wanted")
        self.recompute_core_distances()
        points, core, before = self.table("points").select("id", "item"), self.table("core").select("id", "core"), self.table("labels")
        if not moved_items(core, before).isEmpty():
            edges = self.table("edges")
            new = renew(points, core, edges, self.table("forest"), before, self.metric)
            labels, k = forest_labels(n, new.forest, core, size, points)
            unused = self.refreshed.get("names", 0)
            names = cut(matched_names(labels, k, before, unused))
            top = names.agg(F.max("name").alias("top")).first()["top"]
            rows = labels.join(F.broadcast(names) if k <= NAMES else names, "label", "left").join(core, "id").select("id", "label", "name", "core")
            tables = {"forest": new.forest, "labels": rows}
            bridged = 0
            if new.bridges is not None:
                tables["edges"], bridged = new.bridges, new.bridges.count()
            seen = {"items": n, "changed": new.changed, "taken": new.candidates, "edges": self.metrics["edges"] + bridged, "bridges": bridged, "whole": new.whole, "clusters": k, "names": unused if top is None else max(unused, top + 1)}
            self._write(tables, whole=("forest", "labels"), refreshed=seen)
        return self.table("labels").select("id", "label", "name")

    def core_distance(self, item: int) -> float | None:
        """An item's core distance; None if it is unknown, not computed yet, or infinite."""
        row = self.table("core").where((F.col("id") == item) & ~F.col("dirty")).select("core").collect()
        return row[0]["core"] if row and row[0]["core"] is not None and row[0]["core"] < float("inf") else None
