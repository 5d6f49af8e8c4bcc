"""Token counts from an exact histogram of encoded lengths.

Documents are encoded where they lie and reduced to one number each; the histogram is a partial aggregate, so only distinct
lengths move. Every later answer reads the histogram: suffix sums over it give, for any context limit, how many documents
exceed it and how many tokens stay after truncation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowlens.llm import bpe
from flowlens.llm.common import Scratch

#: Lengths per block of the two-level suffix sums; blocks are summed first, so no task orders all lengths.
BLOCK = 1024


def lengths(docs: DataFrame, column: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """One row ``n_tokens`` per document; null and empty texts count 0, repeated rows each count.

    A very long text is counted whole, a bounded part at a time; an empty table gives no rows.
    """
    path, pattern = path or bpe.default_path(), pattern or bpe.default_pattern()

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        vocab = bpe.vocabulary(path, pattern)
        return pd.Series(np.fromiter(vocab.count_all(texts.fillna("").tolist()), np.int64, len(texts)))

    return docs.select(count(F.col(column)).alias("n_tokens"))


def histogram(docs: DataFrame, column: str = "text", path: str | None = None,
              pattern: str | None = None) -> DataFrame:
    """``n_tokens, n_docs`` for every length that occurs; an empty table gives no row."""
    return lengths(docs, column, path, pattern).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """Per length L: documents and tokens of at least L, and of the whole corpus truncated at L.

    Adds ``docs_from, tokens_from`` (documents of L tokens or more, and their tokens), ``tokens_truncated`` (sum of
    min(n, L)), ``docs_total, tokens_total`` and ``share_within`` (share of documents that fit into L).
    """
    tokens = F.col("n_tokens") * F.col("n_docs")
    rows = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    blocks = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"),
                           F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
                           F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    inside = W.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return (rows.select("block", "n_tokens", "n_docs", F.sum("n_docs").over(inside).alias("d"),
                        F.sum(tokens).over(inside).alias("t"))
            .join(blocks, "block")
            .select("n_tokens", "n_docs", (F.col("d") + F.col("d_above")).alias("docs_from"),
                    (F.col("t") + F.col("t_above")).alias("tokens_from"), "docs_total", "tokens_total")
            .withColumn("tokens_truncated", F.col("tokens_total") - F.col("tokens_from")
                        + F.col("n_tokens") * F.col("docs_from"))
            .withColumn("share_within", (F.col("docs_total") - F.col("docs_from") + F.col("n_docs"))
                        / F.col("docs_total")))


def report(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The suffix sums of a table of documents; the histogram is written once, so that texts are encoded once."""
    return suffix_sums((scratch or Scratch(docs.sparkSession)).keep(histogram(docs), "length-histogram"))


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """``limit, tokens_truncated, docs_over`` for given context limits, from ``suffix_sums``.

    The shortest length above a limit has the suffix sums of exactly the documents that are cut. No row for no documents.
    """
    rows = sums.withColumn("limit", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in sorted(set(limits))])))
    above = F.when(F.col("n_tokens") > F.col("limit"), F.col("n_tokens"))
    first = rows.groupBy("limit").agg(F.max("tokens_total").alias("all_tokens"),
                                      F.min_by(F.struct("docs_from", "tokens_from"), above).alias("cut"))
    docs, tokens = (F.coalesce(F.col(f"cut.{name}"), F.lit(0)) for name in ("docs_from", "tokens_from"))
    return first.select("limit", (F.col("all_tokens") - tokens + docs * F.col("limit")).alias("tokens_truncated"),
                        docs.alias("docs_over"))


def quantiles(sums: DataFrame, probabilities: list[float]) -> DataFrame:
    """``p, n_tokens``: the least length that at least a share p of the documents does not exceed."""
    rows = sums.select("n_tokens", "share_within", F.explode(F.array(*[F.lit(float(p)) for p in probabilities]))
                       .alias("p"))
    return rows.where(F.col("share_within") >= F.col("p")).groupBy("p").agg(F.min("n_tokens").alias("n_tokens"))
