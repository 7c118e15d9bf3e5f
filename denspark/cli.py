"""Command line: cluster a Parquet column of vectors or the lines of a text file.

    python -m denspark.cli run [--min-cluster-size N] [--max-bytes B] parquet PATH --column C [--name NAME]
    python -m denspark.cli run [--min-cluster-size N] [--max-bytes B] text PATH --metric levenshtein [--name NAME]
"""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

from denspark.config import ClusterConfig
from denspark.errors import DensparkError
from denspark.functions.distance import EUCLIDEAN, METRICS
from denspark.functions.scalar import parse_byte_size, source_name
from denspark.lineage import cut
from denspark.plans.clustering import check_labels, cluster
from denspark.sources.readers import text_lines, vectors_from_parquet
from denspark.sources.sinks import write_summary


class _Json(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"level": record.levelname, "target": record.name, "message": record.getMessage()})


def set_up_logging() -> None:
    """Logs go to stderr; DENSPARK_LOG_FORMAT is human or json, DENSPARK_LOG the level."""
    handler = logging.StreamHandler(sys.stderr)
    if os.environ.get("DENSPARK_LOG_FORMAT", "human") == "json":
        handler.setFormatter(_Json())
    logging.basicConfig(level=os.environ.get("DENSPARK_LOG", "INFO").upper(), handlers=[handler])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="denspark")
    run = top.add_subparsers(dest="command", required=True).add_parser("run")
    run.add_argument("--min-cluster-size", type=int, default=5)
    run.add_argument("--max-bytes", type=parse_byte_size)
    kinds = run.add_subparsers(dest="kind", required=True)
    vectors = kinds.add_parser("parquet")
    vectors.add_argument("path")
    vectors.add_argument("--column", required=True)
    text = kinds.add_parser("text")
    text.add_argument("path")
    text.add_argument("--metric", choices=["levenshtein"], required=True)
    for p in (vectors, text):
        p.add_argument("--name")
    return top


def main(args: list[str] | None = None, out=sys.stdout, spark: SparkSession | None = None) -> int:
    """0 if it went well, 1 for a coded error."""
    given = parser().parse_args(args)
    set_up_logging()
    try:
        config = ClusterConfig(min_cluster_size=given.min_cluster_size, max_bytes=given.max_bytes)
        spark = spark or SparkSession.builder.appName("denspark").getOrCreate()
        if given.kind == "parquet":
            points, metric = vectors_from_parquet(spark, given.path, given.column), EUCLIDEAN
        else:
            points, metric = text_lines(spark, given.path), METRICS[given.metric]
        labels = cut(cluster(cut(points), config, metric))
        write_summary(source_name(given.path, given.name), labels, check_labels(labels), out)
    except DensparkError as e:
        logging.getLogger("denspark").error("%s: %s", e.code, e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
