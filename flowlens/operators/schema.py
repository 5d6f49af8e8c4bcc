"""Schema work: metadata columns, alignment to a feature list, row validation, predicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.numeric import INF
from flowlens.spec import BENIGN, METADATA_COLUMNS, WIDE_METADATA_COLUMNS


def drop_metadata(df: DataFrame, wide: bool = False, names: list[str] | None = None) -> DataFrame:
    """Drop identifying columns, matched after trimming their names."""
    unwanted = set(names if names is not None else WIDE_METADATA_COLUMNS if wide else METADATA_COLUMNS)
    return df.drop(*[c for c in df.columns if c.strip() in unwanted])


def align_map(features_map: Column, names: list[str]) -> list[Column]:
    """P5: one column per name out of a ``map<string,double>``; an absent name gives 0.0."""
    return [F.coalesce(F.try_element_at(features_map, F.lit(n)), F.lit(0.0)).alias(n) for n in names]


def align_by_name(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """P5: the wanted features in order; an absent column is 0.0."""
    present = set(df.columns)
    aligned = [
        F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) if n in present else F.lit(0.0).alias(n) for n in names
    ]
    return df.select(*(keep or []), *aligned)


def align_by_position(df: DataFrame, names: list[str], keep: list[str] | None = None) -> DataFrame:
    """The i-th column becomes the i-th feature; missing trailing features are 0.0, extra columns are cut.

    Only for data without usable headers: it is silently wrong when the order differs.
    """
    keep = keep or []
    sources = [c for c in df.columns if c not in keep]
    columns = [
        F.col(sources[i]).cast("double").alias(n) if i < len(sources) else F.lit(0.0).alias(n)
        for i, n in enumerate(names)
    ]
    return df.select(*keep, *columns)


def check_feature_count(df: DataFrame, names: list[str]) -> None:
    """Every expected feature must exist; raised while planning, before any job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"expected {len(names)} features, {len(names) - len(missing)} present; missing {missing[:5]}")


def failed_rules(
    required: list[str] | None = None, integers: list[str] | None = None, non_negative: list[str] | None = None
) -> Column:
    """``array<struct<column,rule>>`` of the rules a row breaks."""
    checks = []

    def rule(name: str, text: str, broken: Column) -> None:
        checks.append(F.when(broken, F.struct(F.lit(name).alias("column"), F.lit(text).alias("rule"))))

    for n in required or []:
        rule(n, "required", F.col(n).isNull() | F.isnan(F.col(n).cast("double")))
    for n in integers or []:
        rule(n, "integer", F.col(n) != F.floor(F.col(n).cast("double")))
    for n in non_negative or []:
        rule(n, "non_negative", F.col(n) < 0)
    return F.array_compact(F.array(*checks))


def validate_rows(df: DataFrame, defaults: dict[str, float] | None = None, **rules) -> DataFrame:
    """Defaults filled in, then ``failed_rules`` as a column; valid rows have an empty array."""
    filled = df.fillna(defaults) if defaults else df
    return filled.withColumn("failed_rules", failed_rules(**rules))


def filter_benign(df: DataFrame, label: str = "label", benign: str = BENIGN) -> DataFrame:
    """A plain comparison, so it is pushed into the scan."""
    return df.where(F.col(label) == benign)


def filter_label_contains(df: DataFrame, text: str, label: str = "label") -> DataFrame:
    """A NULL label never matches."""
    return df.where(F.col(label).contains(text))


def recode_prediction(raw: Column) -> Column:
    """P10: -1 / 1 -> 1 / 0."""
    return F.when(raw < 0, F.lit(1)).otherwise(F.lit(0))


def label_text(prediction: Column) -> Column:
    return F.when(prediction == 1, F.lit("ATTACK")).otherwise(F.lit("BENIGN"))


def explanation_text(prediction: Column, top_feature: Column, confidence: Column) -> Column:
    """One sentence per row. The wording below is a fixed value."""
    attack = F.format_string(
        "🚨 ATTACK DETECTED: This network flow shows anomalous behavior. "
        "Key indicator: '%s' deviates significantly from normal patterns. "
        "Confidence: %.1f%%. Recommend blocking or investigating this flow.",
        top_feature, confidence,
    )
    benign = F.format_string(
        "✅ BENIGN TRAFFIC: This network flow appears normal. "
        "Confidence: %.1f%%. All features within expected ranges.",
        confidence,
    )
    return F.when(prediction == 1, attack).otherwise(benign)


def detected_rows(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Rows predicted as attacks."""
    return df.where(F.col(prediction) == 1)


def violations(df: DataFrame, features: list[str]) -> DataFrame:
    """Number of missing and infinite feature values, one row."""
    bad = lambda f: F.when(F.col(f).isNull() | (F.abs(F.col(f)) >= F.lit(INF)), 1).otherwise(0)
    return df.agg(F.coalesce(F.sum(sum((bad(f) for f in features), F.lit(0))), F.lit(0)).alias("violations"))


def assert_finite(df: DataFrame, features: list[str]) -> DataFrame:
    """C12, strict: the frame itself, failing at run time on the first missing or infinite value."""
    message = F.lit("missing or infinite feature value")
    checked = [
        F.when(F.col(f).isNull() | (F.abs(F.col(f)) >= F.lit(INF)), F.raise_error(message).cast("double"))
        .otherwise(F.col(f)).alias(f) if f in features else F.col(f)
        for f in df.columns
    ]
    return df.select(*checked)
