"""Registered queries of the training-data operators: thin calls with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilspark.llm import cube_mixing, decontamination, exact_dedup, filter_audit, jaccard_join, language_id, line_templates, pii_spans, quality_mil, quality_rules, spelling_groups, suffix_dedup, warc
from veilspark.llm.util import table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op1(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.op2(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op3(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans.op4(table(spark, sf_dir, "documents"))


def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.op5(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_mixing.op6(table(spark, sf_dir, "documents"))


def op7_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.op7(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.op8(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op9(table(spark, sf_dir, "pages"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.op10(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups.op11(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op12(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.op13(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_quality, op3_decontaminate, op4_pii, op5_lines, op6_mixing, op7_jaccard, op8_language_id, op9_warc, op10_rules, op11_spelling, op12_exact_dedup, op13_filter_audit)}


def oracle_sql() -> dict[str, str]:
    return {"op1_suffix_dedup": suffix_dedup.ORACLE_SQL, "op7_jaccard": jaccard_join.ORACLE_SQL, "op4_pii": pii_spans.ORACLE_SQL, "op5_lines": line_templates.ORACLE_SQL, "op9_warc": warc.ORACLE_SQL, "op11_spelling": spelling_groups.ORACLE_SQL, "op12_exact_dedup": exact_dedup.ORACLE_SQL, "op13_filter_audit": filter_audit.ORACLE_SQL}
