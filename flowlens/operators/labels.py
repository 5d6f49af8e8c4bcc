"""Label encoding and distribution (L1-L4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from flowlens.operators.ordering import with_position
from flowlens.spec import BENIGN

ORIGINAL = "label_original"
#: Labels that the driver may order.
FEW = 10_000


def encode_binary(df: DataFrame, label: str = "label", benign: str = BENIGN) -> DataFrame:
    """L1: 0 for benign, 1 for everything else, a missing label included; the text stays in ``label_original``."""
    if label not in df.columns:
        return df
    return df.withColumns({
        ORIGINAL: F.col(label),
        label: (~F.col(label).eqNullSafe(benign)).cast("int"),
    })


def label_mapping(df: DataFrame, label: str = "label") -> DataFrame:
    """L2: (label, code) with codes 0..k-1 in text order (UTF-8 bytes).

    Up to ``FEW`` labels are ordered here; more of them get their place in a global order, never in one task.
    """
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    known = [row[0] for row in distinct.limit(FEW + 1).collect()]
    if len(known) <= FEW:
        known.sort(key=lambda text: text.encode() if isinstance(text, str) else text)
        kind = df.schema[label].dataType.simpleString()
        return df.sparkSession.createDataFrame(list(zip(known, range(len(known)))), f"`{label}` {kind}, code int")
    return with_position(distinct, [F.col(label).asc()], "code").select(label, F.col("code").cast("int").alias("code"))


def binary_mapping(df: DataFrame, label: str = "label", benign: str = BENIGN) -> DataFrame:
    """L1: (label, code) of the labels that occur."""
    return df.select(label).distinct().withColumn("code", (~F.col(label).eqNullSafe(benign)).cast("int"))


def encode_multiclass(df: DataFrame, label: str = "label") -> DataFrame:
    """L2 applied: the label column becomes its code, a missing label stays missing.

    The codes are a table for any number of labels; whether it is sent along or shuffled is the planner's choice.
    """
    if label not in df.columns:
        return df
    codes = label_mapping(df, label).select(F.col(label).alias("_known"), F.col("code").alias("_code"))
    coded = df.join(codes, F.col(label) == F.col("_known"), "left")
    return coded.withColumns({ORIGINAL: F.col(label), label: F.col("_code")}).drop("_known", "_code")


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """L3/E5: count and share per label; the share is a window over one row per label."""
    counts = df.groupBy(label).agg(F.count("*").alias("count"))
    return counts.select(label, "count", (F.col("count") / F.sum("count").over(Window.partitionBy())).alias("share"))
