"""The training-data pipeline: quality rules, near-duplicates, benchmark passages, personal data, token ids.

Each stage is ``(spark, docs, sf_dir) -> DataFrame`` and works on all that the one before kept. ``run`` writes every
stage as Parquet to the shared folder and reads it again, so a lost executor never sends work back beyond a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import bpe, decontaminate, pii, quality, simhash
from flowlens.llm.common import Scratch, table


# What holds for every stage: columns keep their names and order, whatever they are called (the last stage has its own);
# an empty table gives an empty one; very long texts are worked on whole.


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the threshold table accepts; null and empty texts are not, repeated rows are judged alike."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that with the least id, a null id last.

    Among rows of the least id that text which hashes least stays; full copies are one document. Texts without words are one
    group.
    """
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none, repeated rows go or stay together."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their entities replaced; ``n_chars``, where there is one, follows the new text.

    Null texts stay null, with a null ``n_chars``; equal texts get equal replacements.
    """
    made = pii.protect(docs)
    if "n_chars" not in docs.columns:
        return made
    return made.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_tokens, ids`` and whether the ids decode to the text.

    A null text counts as empty and has no ids; ids, languages and sources may be null; repeated rows give a row each.
    """
    made = bpe.encode(docs.select("doc_id", "lang", "source", "text"), "text", "ids", decoded="decoded")
    return made.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("pii_surrogates", pii_surrogates),
    ("byte_bpe", byte_bpe),
]

#: SimHash, surrogates and byte pairs have no SQL; tests compare the kept rows with the reports of the operators, which
#: have tests of their own.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
