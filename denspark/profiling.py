"""Wall time and peak memory of a piece of work on the driver and its local processes."""

from __future__ import annotations

import os
import threading
import time
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAGE = os.sysconf("SC_PAGE_SIZE")


def resident_bytes() -> int:
    """Memory that this process and all below it hold now (on systems with /proc, else 0)."""
    parents, sizes = {}, {}
    for path in Path("/proc").glob("[0-9]*"):
        try:
            stat = (path / "stat").read_text()
            sizes[int(path.name)] = int((path / "statm").read_text().split()[1]) * _PAGE
        except OSError:
            continue  # it has ended
        parents[int(path.name)] = int(stat.rpartition(")")[2].split()[1])
    total = 0
    for pid, size in sizes.items():
        up = pid
        while up and up != os.getpid():
            up = parents.get(up, 0)
        total += size if up else 0
    return total


@dataclass
class Profile:
    """Measures a ``with`` block: ``seconds``, and ``peak_bytes`` of memory, looked at every ``interval`` seconds."""

    interval: float = 0.05
    seconds: float = 0.0
    peak_bytes: int = 0
    samples: int = 0
    _stop: threading.Event = field(default_factory=threading.Event, repr=False)

    def _look(self) -> None:
        self.peak_bytes = max(self.peak_bytes, resident_bytes())
        self.samples += 1

    def _run(self) -> None:
        while not self._stop.wait(self.interval):
            self._look()

    def __enter__(self) -> Profile:
        self._stop.clear()
        self._look()
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._began = time.perf_counter()
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self._began
        self._stop.set()
        self._thread.join()
        self._look()


def timed(df: DataFrame, *measures: Column) -> tuple[dict, Profile]:
    """Runs all of a DataFrame without keeping its rows: what ``measures`` (aggregates, its number of rows besides) observe, and the profile."""
    from pyspark.sql import Observation

    seen = Observation()
    with Profile() as profile:
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *measures).write.format("noop").mode("overwrite").save()
    return seen.get, profile
