"""The queries opN_<name> and pipeline of the corpus operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.pii import pii_report

    return pii_report(_table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.ngram_join import ngram_join

    return ngram_join(_table(spark, sf_dir, "documents")).drop("node")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.decontaminate import leaks

    return leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.url_filter import url_filter

    return url_filter(_table(spark, sf_dir, "pages"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.suffix_dedup import dedup_report

    return dedup_report(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.chat_format import chat_report

    return chat_report(_table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.simhash_dedup import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.filter_audit import audit

    return audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from denspark.llm.fill_in_middle import fim_report

    return fim_report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    found = dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))
    return found | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    from denspark.llm import chat_format, fill_in_middle, filter_audit, mixing, ngram_join, url_filter

    return {"op3_ngram_join": ngram_join.ORACLE_SQL, "op5_url_filter": url_filter.ORACLE_SQL, "op7_chat_format": chat_format.ORACLE_SQL, "op9_mixing": mixing.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_fill_in_middle": fill_in_middle.ORACLE_SQL}
