"""The registered queries of this folder and their SQL twins; every query reads its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowlens.llm import (
    bpe, decontaminate, html, langid, licenses, negatives, phrases, pii, quality, simhash, token_counts, toxicity, urls,
)
from flowlens.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.report(table(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.report(table(spark, sf_dir, "documents"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.rules_table(spark))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.report(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_byte_bpe, op3_html_extraction, op4_pii_surrogates,
                                   op5_language_id, op6_simhash, op7_url_filter, op8_decontamination,
                                   op9_quality_rules, op10_toxicity, op11_license_scan, op12_phrase_collocations,
                                   op13_hard_negatives)}
ORACLES = {"op7_url_filter": urls.sql(), "op8_decontamination": decontaminate.sql(), "op9_quality_rules": quality.sql(),
           "op11_license_scan": licenses.sql(), "op12_phrase_collocations": phrases.sql(),
           "op13_hard_negatives": negatives.sql()}
