"""FlowCleaner: duplicates, metadata, infinite and missing values, constant features.

``fit`` learns a table of at most one row per feature; ``transform`` is a projection and a filter (plus the duplicate
aggregate), so it applies to any frame or stream with the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.functions.numeric import INF, finite, is_infinite, is_missing, long_form, null_if_nan
from flowlens.operators.quantiles import exact_percentiles
from flowlens.operators.schema import drop_metadata
from flowlens.spec import RESCUED, numeric_columns

INF_RULES = ("replace", "drop", "ignore")
NAN_RULES = ("drop", "mean", "median", "zero", "ignore")


@dataclass(frozen=True)
class FeatureRule:
    """What cleaning does to one feature."""

    feature: str
    positive_inf: float | None = None
    negative_inf: float | None = None
    missing: float | None = None
    constant: bool = False


def distinct_rows(df: DataFrame) -> DataFrame:
    """Full copies once. Rows that differ in a rescued text only are no copies."""
    if RESCUED not in df.columns:
        return df.dropDuplicates()
    return df.withColumn(RESCUED, F.map_entries(RESCUED)).dropDuplicates().withColumn(RESCUED, F.map_from_entries(RESCUED))


class FlowCleaner(Estimator):
    """C11. Rules run in a fixed order: duplicates, metadata, infinite, missing, constant features."""

    def __init__(self, features: list[str] | None = None, label: str = "label", handle_inf: str = "replace",
                 handle_nan: str = "drop", inf_replacement: float | None = None, remove_duplicates: bool = True,
                 remove_constant: bool = True, missing_fallback: float | None = None, keep: list[str] | None = None):
        super().__init__()
        if handle_inf not in INF_RULES or handle_nan not in NAN_RULES:
            raise ValueError(f"handle_inf in {INF_RULES}, handle_nan in {NAN_RULES}")
        self.features, self.label = features, label
        self.handle_inf, self.handle_nan, self.inf_replacement = handle_inf, handle_nan, inf_replacement
        self.remove_duplicates, self.remove_constant = remove_duplicates, remove_constant
        self.missing_fallback, self.keep_columns = missing_fallback, list(keep or [])

    def _fit(self, df: DataFrame) -> "FlowCleanerModel":
        features = self.features or [
            c for c in numeric_columns(drop_metadata(df)) if c != self.label and c not in self.keep_columns
        ]
        # Extremes, constancy and "any missing" do not change with duplicates: only averages need them removed.
        exact_rows = self.remove_duplicates and self.handle_nan in ("mean", "median")
        rows = distinct_rows(df) if exact_rows else df
        if self.handle_inf == "drop":
            rows = rows.where(~_any_infinite(features))
        others = [c for c in df.columns if c not in features and c != RESCUED]
        stats = {r["feature"]: r for r in _feature_stats(
            rows, features, others if self.handle_nan == "drop" and self.remove_constant else None).collect()}

        positive, negative = {}, {}
        for f in features:
            s = stats.get(f)
            if self.handle_inf == "replace" and s is not None:
                given = self.inf_replacement
                positive[f] = s["high"] if given is None else float(given)
                negative[f] = s["low"] if given is None else float(given)
        replaced = {f: _replaced(f, positive.get(f), negative.get(f), self.handle_inf) for f in features}

        missing_total = sum(
            s["missing"] + (s["inf_pos"] + s["inf_neg"] if self._inf_turns_missing(s) else 0) for s in stats.values()
        )
        drop_rows = self.handle_nan == "drop" and missing_total > 0
        fill = self._fill_values(rows, features, stats, replaced, positive, negative)
        constant = self._constant(rows, features, stats, replaced, fill, drop_rows, others)
        rules = [
            FeatureRule(f, positive.get(f), negative.get(f), fill.get(f), f in constant) for f in features
        ]
        return FlowCleanerModel(rules, self, drop_rows)

    def _inf_turns_missing(self, s) -> bool:
        return self.handle_inf == "replace" and self.inf_replacement is None and s["high"] is None

    def _one_value(self, s) -> bool:
        """Whether the complete rows hold one value of a feature, infinite ones counted as what replaces them."""
        values = {s["whole_low"], s["whole_high"]} - {None}
        for infinite, count, extreme in ((INF, s["whole_pos"], s["high"]), (-INF, s["whole_neg"], s["low"])):
            if count:
                replacement = extreme if self.inf_replacement is None else float(self.inf_replacement)
                values.add(infinite if self.handle_inf == "ignore" else replacement)
        return len(values) == 1

    def _fill_values(self, rows, features, stats, replaced, positive, negative) -> dict[str, float]:
        if self.handle_nan == "zero":
            return {f: 0.0 for f in features}
        fill: dict[str, float | None] = {}
        if self.handle_nan == "mean":
            for f, s in stats.items():
                n = s["n_finite"]
                total = s["total"] or 0.0
                if self.handle_inf == "ignore" and s["inf_pos"] + s["inf_neg"]:
                    fill[f] = INF if not s["inf_neg"] else -INF if not s["inf_pos"] else None
                    continue
                for count, value in ((s["inf_pos"], positive.get(f)), (s["inf_neg"], negative.get(f))):
                    if count and value is not None:
                        n, total = n + count, total + count * value
                fill[f] = total / n if n else None
        elif self.handle_nan == "median":
            medians = exact_percentiles(rows, {f: replaced[f] for f in features}, [0.5])
            fill = {f: medians[(f, 0.5)] for f in features}
        if self.missing_fallback is not None and self.handle_nan in ("mean", "median"):
            fill = {f: self.missing_fallback if fill.get(f) is None else fill[f] for f in features}
        return {f: v for f, v in fill.items() if v is not None}

    def _constant(self, rows, features, stats, replaced, fill, drop_rows, others) -> set[str]:
        if not self.remove_constant:
            return set()
        if drop_rows and not any(s["inf_pos"] + s["inf_neg"] and self._inf_turns_missing(s) for s in stats.values()):
            return {f for f, s in stats.items() if self._one_value(s)}
        if drop_rows:
            complete = rows.select(*[replaced[f].alias(f) for f in features], *others).na.drop()
            ranges = long_form(complete, features).groupBy("feature").agg(
                F.min("value").alias("low"), F.max("value").alias("high"))
            return {r["feature"] for r in ranges.collect() if r["low"] is not None and r["low"] == r["high"]}
        constant = set()
        for f, s in stats.items():
            values = {s["low"], s["high"]}
            if s["inf_pos"]:
                values.add(INF if self.handle_inf == "ignore" else self.inf_replacement)
            if s["inf_neg"]:
                values.add(-INF if self.handle_inf == "ignore" else self.inf_replacement)
            if s["missing"] or self._inf_turns_missing(s):
                values.add(fill.get(f))
            values.discard(None)
            if len(values) == 1:
                constant.add(f)
        return constant


class FlowCleanerModel(Model):
    """The learned rules; ``rules_frame`` is the whole state."""

    def __init__(self, rules: list[FeatureRule], cleaner: FlowCleaner, drop_missing_rows: bool):
        super().__init__()
        self.rules, self.drop_missing_rows = rules, drop_missing_rows
        self.handle_inf, self.remove_duplicates = cleaner.handle_inf, cleaner.remove_duplicates
        self.kept_features = [r.feature for r in rules if not r.constant]
        self.constant_features = [r.feature for r in rules if r.constant]

    def _transform(self, df: DataFrame) -> DataFrame:
        return self._clean_rows(distinct_rows(df) if self.remove_duplicates else df)

    def _clean_rows(self, rows: DataFrame) -> DataFrame:
        rows = drop_metadata(rows)
        by_name = {r.feature: r for r in self.rules}
        if self.handle_inf == "drop":
            rows = rows.where(~_any_infinite(list(by_name)))
        out = []
        for c in rows.columns:
            rule = by_name.get(c)
            if rule is None:
                out.append(F.col(c))
                continue
            value = _replaced(c, rule.positive_inf, rule.negative_inf, self.handle_inf)
            out.append((value if rule.missing is None else F.coalesce(value, F.lit(rule.missing))).alias(c))
        cleaned = rows.select(*out)
        if self.drop_missing_rows:
            cleaned = cleaned.na.drop(subset=[c for c in cleaned.columns if c != RESCUED])
        return cleaned.drop(*self.constant_features)

    def report(self, df: DataFrame) -> DataFrame:
        """Rows before and after, duplicates removed, features before and after: one row, one shuffle."""
        if self.remove_duplicates:
            groups = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
        else:
            groups = df.withColumn("_copies", F.lit(1).cast("bigint"))
        kept = self._clean_rows(groups)
        per_group = F.lit(1) if self.remove_duplicates else F.col("_copies")
        final = kept.agg(F.coalesce(F.sum(per_group), F.lit(0)).cast("bigint").alias("final_rows"))
        initial = groups.agg(
            F.coalesce(F.sum("_copies"), F.lit(0)).cast("bigint").alias("initial_rows"),
            F.coalesce(F.sum(F.col("_copies") - per_group), F.lit(0)).cast("bigint").alias("duplicates_removed"),
        )
        return initial.select(
            "initial_rows", "duplicates_removed", final.scalar().alias("final_rows"),
            (F.col("initial_rows") - final.scalar()).alias("rows_removed"),
            F.lit(len(self.constant_features)).alias("constant_features_removed"),
            F.lit(len(self.kept_features)).alias("features_kept"),
        )

    def rules_frame(self, spark) -> DataFrame:
        schema = ("feature string, positive_inf double, negative_inf double, missing double, constant boolean")
        return spark.createDataFrame(
            [(r.feature, r.positive_inf, r.negative_inf, r.missing, r.constant) for r in self.rules], schema)


def _any_infinite(features: list[str]) -> Column:
    condition = F.lit(False)
    for f in features:
        condition = condition | is_infinite(F.col(f))
    return condition


def _replaced(feature: str, positive: float | None, negative: float | None, handle_inf: str) -> Column:
    """The feature with NaN as NULL and infinities replaced (an unknown replacement gives NULL)."""
    x = null_if_nan(F.col(feature).cast("double"))
    if handle_inf != "replace":
        return x
    return F.when(x == F.lit(INF), F.lit(positive)).when(x == F.lit(-INF), F.lit(negative)).otherwise(x)


def _feature_stats(df: DataFrame, features: list[str], others: list[str] | None = None) -> DataFrame:
    """One row per feature from one pass; partial sums are combined before the (tiny) shuffle.

    With ``others`` also ``whole_`` figures: of the rows without a missing value in any feature or other column.
    """
    value, whole = F.col("value"), F.col("_whole")
    x = finite(value)
    figures = [
        F.min(x).alias("low"), F.max(x).alias("high"), F.sum(x).alias("total"), F.count(x).alias("n_finite"),
        F.count_if(value == F.lit(INF)).alias("inf_pos"), F.count_if(value == F.lit(-INF)).alias("inf_neg"),
        F.count_if(value.isNull() | F.isnan(value)).alias("missing"),
    ]
    if others is None:
        return long_form(df, features).groupBy("feature").agg(*figures)
    fractions = [name for name, kind in df.dtypes if kind in ("float", "double")]
    absent = [is_missing(F.col(f).cast("double")) for f in features] + [
        is_missing(F.col(c)) if c in fractions else F.col(c).isNull() for c in others]
    marked = df.withColumn("_whole", ~F.greatest(F.lit(False), F.lit(False), *absent))
    return long_form(marked, features, "_whole").groupBy("feature").agg(
        *figures, F.min(F.when(whole, x)).alias("whole_low"), F.max(F.when(whole, x)).alias("whole_high"),
        F.count_if(whole & (value == F.lit(INF))).alias("whole_pos"),
        F.count_if(whole & (value == F.lit(-INF))).alias("whole_neg"))


def replace_infinite(df: DataFrame, features: list[str], value: float) -> DataFrame:
    """Both infinities become ``value``; no statistics needed."""
    return df.withColumns({f: F.when(is_infinite(F.col(f)), F.lit(float(value))).otherwise(F.col(f)) for f in features})


def drop_infinite(df: DataFrame, features: list[str]) -> DataFrame:
    """C4."""
    return df.where(~_any_infinite(features))


def clamp_and_fill_median(df: DataFrame, features: list[str], clamp: float = 1.7976931348623157e308) -> DataFrame:
    """Both infinities become the largest double, missing values the column median (0 if all are missing)."""
    cleaner = FlowCleaner(features, handle_inf="replace", inf_replacement=clamp, handle_nan="median",
                          remove_duplicates=False, remove_constant=False, missing_fallback=0.0)
    return cleaner.fit(df).transform(df)
