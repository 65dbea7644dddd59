"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillweave.llm import ann, audit, chat, decontam, licences, mixing, neardup, pii, quality, repeats, resample, sharding, urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.report(_table(spark, folder, "documents"))


def op2_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.report(_table(spark, folder, "conversations"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(_table(spark, folder, "documents"))


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(_table(spark, folder, "documents"))


def op5_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.report(_table(spark, folder, "documents"), 85)


def op6_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(_table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.report(_table(spark, folder, "documents"))


def op8_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.report(_table(spark, folder, "documents"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.report(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.report(_table(spark, folder, "pages"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample.ranked(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op12_nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return ann.report(_table(spark, folder, "embeddings"))


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_licence_scan, op2_chat_formatting, op3_quality_rules, op4_pii, op5_near_duplicates, op6_mix_sources, op7_sharding, op8_repeated_passages, op9_decontamination, op10_url_filters, op11_importance_resampling, op12_nearest_neighbours, op13_filter_audit)
}
ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.REPORT_SQL, "op6_mix_sources": mixing.REPORT_SQL, "op8_repeated_passages": repeats.REPORT_SQL, "op9_decontamination": decontam.REPORT_SQL, "op11_importance_resampling": resample.REPORT_SQL, "op13_filter_audit": audit.REPORT_SQL,
}
