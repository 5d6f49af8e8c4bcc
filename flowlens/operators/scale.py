"""Standard and min-max scaling with the population standard deviation."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.numeric import long_form, null_if_nan

SCHEMA = "feature string, mean double, std double, min double, max double"


def feature_moments(df: DataFrame, features: list[str]) -> DataFrame:
    """``(feature, mean, std, min, max)``: one pass, one row per feature; also the baseline of the drift check."""
    value = null_if_nan(F.col("value"))
    return long_form(df, features).groupBy("feature").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )


class FlowScaler(Estimator):
    """Z1 (``standard``) or Z2 (``minmax``); a zero spread divides by 1."""

    def __init__(self, features: list[str], kind: str = "standard"):
        super().__init__()
        if kind not in ("standard", "minmax"):
            raise ValueError("kind is 'standard' or 'minmax'")
        self.features, self.kind = list(features), kind

    def _fit(self, df: DataFrame) -> "FlowScalerModel":
        rows = {r["feature"]: r for r in feature_moments(df, self.features).collect()}
        table = [(f, rows[f]["mean"], rows[f]["std"], rows[f]["min"], rows[f]["max"]) if f in rows
                 else (f, None, None, None, None) for f in self.features]
        return FlowScalerModel(table, self.kind)


class FlowScalerModel(Model):
    """The statistics as literals inside a projection: no join, no shuffle."""

    def __init__(self, table: list[tuple], kind: str):
        super().__init__()
        self.table, self.kind = table, kind
        self.features = [t[0] for t in table]

    def parameters(self) -> dict[str, tuple[float, float]]:
        """feature -> (shift, divisor)."""
        out = {}
        for feature, mean, std, low, high in self.table:
            if self.kind == "standard":
                shift, spread = mean, std
            else:
                shift, spread = low, None if low is None else high - low
            out[feature] = (shift or 0.0, spread if spread else 1.0)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        params = self.parameters()
        return df.select(*[
            ((F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1])).alias(c) if c in params else F.col(c)
            for c in df.columns
        ])

    def inverse(self, df: DataFrame) -> DataFrame:
        """Z3: back to original units."""
        params = self.parameters()
        return df.select(*[
            (F.col(c) * F.lit(params[c][1]) + F.lit(params[c][0])).alias(c) if c in params else F.col(c)
            for c in df.columns
        ])

    def to_frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.table, SCHEMA)

    @classmethod
    def from_frame(cls, df: DataFrame, kind: str = "standard") -> "FlowScalerModel":
        return cls([tuple(r) for r in df.select("feature", "mean", "std", "min", "max").collect()], kind)
