"""Reports: cluster summaries as text, measurement rows as CSV."""

from __future__ import annotations

import csv
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of each report.
REPORTS = {
    "recall": ["source", "n", "m", "ef_construction", "k", "hits", "total", "recall"],
    "quality": ["source", "n", "m", "ef_construction", "min_cluster_size", "ari", "nmi"],
    "memory": ["n", "m", "peak_bytes", "edges", "bytes_per_point", "bytes_per_edge"],
    "lanes": ["dimension", "candidates", "lane_basis_points"],
    "build": ["n", "dimension", "build_ns", "scoring_ns", "scoring_basis_points", "calls", "least", "most", "median"],
}


def write_summary(name: str, labels: DataFrame, clusters: int, out: TextIO) -> None:
    """Two head lines, then id and label of each item in order; rows stream through the driver."""
    out.write(f"data source: {name}\nclusters: {clusters}\n")
    for row in labels.orderBy("id").toLocalIterator():
        out.write(f"{row['id']}\t{row['label']}\n")


def save_summary(labels: DataFrame, path: str) -> None:
    """The same rows as tab-separated files in order, written by the tasks."""
    labels.orderBy("id").select("id", "label").write.mode("overwrite").csv(path, sep="\t")


def write_report(kind: str, rows: list[dict], path: str | Path) -> None:
    """A small report as one CSV file; fractions have six decimals."""
    with Path(path).open("w", newline="") as f:
        out = csv.DictWriter(f, REPORTS[kind], lineterminator="\n")
        out.writeheader()
        out.writerows({k: f"{v:.6f}" if isinstance(v, float) else v for k, v in row.items()} for row in rows)


def save_report(rows: DataFrame, path: str) -> None:
    """A report of any size as CSV files with a header; fractions have six decimals."""
    out = [F.format_number(c, 6).alias(c) if kind in ("float", "double") else F.col(c) for c, kind in rows.dtypes]
    rows.select(out).write.mode("overwrite").csv(path, header=True)
