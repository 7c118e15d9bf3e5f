"""Cutting lineage with files that every executor can read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one where that is unset on a single machine (tests).

    On a cluster every executor would write to a disk of its own, so there the setting must be given.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        folder = tempfile.mkdtemp(prefix="denspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in the shared folder: lost executors read it again, nothing recomputes."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Like :func:`cut`, written as compressed Parquet: for wide intermediates that are read more than once."""
    path = f"{shared_dir(df.sparkSession)}/denspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Rows of an Arrow batch of texts.
BATCH = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH rows instead of Spark's default of 10,000, which at some KB a text is over 30 MB for each task, held outside the heap and again in Python.

    A session that has another setting keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH))
