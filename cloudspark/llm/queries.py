"""Queries over the driver's tables, one for each training-data operator, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cloudspark.llm import decontaminate, divergence, exact_dedup, hmm, kneser_ney, line_dedup, negatives, odd_sketch, pii_crf, secret_scan, simhash, sp_codec, wrappers
from cloudspark.llm.common import table


def op1_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.digest(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_codec.digest(table(spark, sf_dir, "documents"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digest(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.digest(table(spark, sf_dir, "pages"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.digest(table(spark, sf_dir, "embeddings"))


def op13_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_sketch.digest(table(spark, sf_dir, "documents"))


def queries() -> dict:
    own = (
        op1_hmm, op2_sentencepiece, op3_simhash, op4_line_dedup, op5_decontamination, op6_secrets, op7_pii, op8_quality, op9_html, op10_exact_dedup,
        op11_divergence, op12_hard_negatives, op13_odd_sketch,
    )
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": line_dedup.SQL, "op10_exact_dedup": exact_dedup.SQL, "op11_divergence": divergence.SQL, "op12_hard_negatives": negatives.SQL}
