"""What each batch of a followed stream held and how long it took."""

from __future__ import annotations

import threading

from pyspark.sql.streaming.listener import StreamingQueryListener


class BatchReports(StreamingQueryListener):
    """Collects a report of each batch of the streaming queries that run while it listens.

    A report: ``query`` (id), ``batch``, ``rows`` read, ``seconds``, ``durations`` of its phases in milliseconds, and
    ``observed``, the named aggregates that the stream was observed by. ``ended`` has the queries that ended, with
    their error if there was one. Reports come from Spark's listener thread, a little after the batch.
    """

    def __init__(self):
        self.batches: list[dict] = []
        self.ended: dict[str, str | None] = {}
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        report = {"query": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "seconds": p.batchDuration / 1000, "durations": dict(p.durationMs), "observed": {name: row.asDict() for name, row in p.observedMetrics.items()}}
        with self._changed:
            self.batches.append(report)
            self._changed.notify_all()

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self.ended[str(event.id)] = event.exception
            self._changed.notify_all()

    def wait_for(self, query: str, seconds: float = 30.0) -> bool:
        """Waits until the reports of a query that ended are all there."""
        with self._changed:
            return self._changed.wait_for(lambda: query in self.ended, seconds)
