"""The registered queries of this subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, html_main, hypermin, lm, mixing, pii, quality, substrings, warc
from .common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"), with_bytes=False)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hypermin.components(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.drawn(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digested(warc.derived(warc.responses(table(spark, sf_dir, "pages"))))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extracted(table(spark, sf_dir, "pages"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(table(spark, sf_dir, "conversations"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_source_mixing": op4_source_mixing,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_html_extraction": op7_html_extraction,
    "op8_pii": op8_pii,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_lm_scoring": op10_lm_scoring,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op3_minhash_near_dedup": hypermin.ORACLE,
    "op4_source_mixing": mixing.oracle(),
    "op5_benchmark_decontamination": decontam.ORACLE,
}
