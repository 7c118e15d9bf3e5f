"""A corpus pipeline: quality, near duplicates, benchmark leaks, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
reread as the next stage's docs. All but the last return the columns of ``documents``; the last
adds ``copies``, how often the mix takes the document.

Defined cases, stage by stage: null and empty texts go in the first stage and are harmless to the
others; null ids, repeated rows and further columns of any name pass through all stages as they are
(of rows equal in id and words the second keeps one); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from denspark.lineage import table
from denspark.llm.decontaminate import without_leaks
from denspark.llm.mixing import take_mix
from denspark.llm.ngram_join import keep_one
from denspark.llm.pii import mask_pii
from denspark.llm.quality_rules import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the rules; the others go, null and empty texts among them. Rows are judged one by one."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram join links: the least id (nulls last), one of rows that tie; texts without words all stay."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and an empty benchmark takes nothing away."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind, and ``n_chars`` set to the new length of those texts; every row stays, null texts as they are."""
    return mask_pii(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies (a column of that name is replaced); texts without words may come along, a null source is one of its own."""
    return take_mix(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("mixing", mixture)]

#: SQL has neither zstandard nor a randomised SVD; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = table(stage(spark, docs, sf_dir))
    return docs
