"""What all detectors share: a scaled feature struct, scoring columns and a parquet form of their state."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.numeric import nan_to_num
from flowlens.operators.scale import FlowScalerModel
from flowlens.operators.schema import check_feature_count


def matrix_column(function: Callable[[np.ndarray], np.ndarray], inputs: Column, returns: str = "double") -> Column:
    """``function(rows x features)`` as a column over a struct of doubles. Only the struct travels to Python."""

    def apply(batch: pd.DataFrame) -> pd.Series:
        out = function(batch.to_numpy(dtype=float, na_value=np.nan))
        return pd.Series(out if out.ndim == 1 else list(out))

    return F.pandas_udf(apply, returns)(inputs)


def prepared(features: list[str], scaler: FlowScalerModel | None) -> Column:
    """A struct of finite, scaled features, computed before rows leave the JVM."""
    params = scaler.parameters() if scaler is not None else {}
    fields = []
    for f in features:
        x = nan_to_num(F.col(f).cast("double"))
        if f in params:
            shift, spread = params[f]
            x = (x - F.lit(shift)) / F.lit(spread)
            # A finite value stays finite unless the statistics themselves are not usable numbers.
            if not (math.isfinite(shift) and math.isfinite(spread) and abs(spread) > 1e-200):
                x = nan_to_num(x)
        fields.append(x.alias(f))
    return F.struct(*fields)


class Detector:
    """A fitted detector. Subclasses give ``matrix_score`` and say which direction is anomalous."""

    kind = ""
    higher_is_worse = True

    features: list[str]
    scaler: FlowScalerModel | None
    threshold: float

    def matrix_score(self) -> Callable[[np.ndarray], np.ndarray]:
        """A small picklable function from scaled rows to raw scores."""
        raise NotImplementedError

    def raw_score(self) -> Column:
        return matrix_column(self.matrix_score(), prepared(self.features, self.scaler))

    def prediction(self, raw: Column) -> Column:
        return (raw > self.threshold).cast("int")

    def probability(self, raw: Column) -> Column:
        raise NotImplementedError

    def transform(self, df: DataFrame) -> DataFrame:
        """``raw_score`` in the model's own direction, ``anomaly_score`` (higher is worse), ``prediction``, probability."""
        check_feature_count(df, self.features)
        raw = F.col("raw_score")
        return df.withColumn("raw_score", self.raw_score()).withColumns({
            "anomaly_score": raw if self.higher_is_worse else -raw,
            "prediction": self.prediction(raw),
            "anomaly_probability": self.probability(raw),
        })

    # ---- state -----------------------------------------------------------------------------------------------------

    def metadata(self) -> dict:
        raise NotImplementedError

    def arrays(self) -> dict[str, np.ndarray]:
        raise NotImplementedError

    @classmethod
    def restore(cls, metadata: dict, arrays: dict[str, np.ndarray]) -> "Detector":
        raise NotImplementedError

    def info(self, spark: SparkSession) -> DataFrame:
        """One row about the model."""
        meta = self.metadata()
        parameters = int(sum(a.size for name, a in self.arrays().items() if not name.startswith(("map_", "support_"))))
        return spark.createDataFrame(
            [(self.kind, len(self.features), parameters, float(self.threshold), json.dumps(meta, sort_keys=True))],
            "kind string, n_features int, n_parameters bigint, threshold double, metadata string")

    def save(self, spark: SparkSession, path: str) -> None:
        """One parquet row per array, one JSON metadata row, the scaler table."""
        meta = {"kind": self.kind, "features": self.features, "threshold": float(self.threshold),
                "scaler": None if self.scaler is None else [self.scaler.kind, self.scaler.table],
                "model": self.metadata()}
        rows = [(name, [int(s) for s in a.shape], [float(v) for v in a.ravel()]) for name, a in self.arrays().items()]
        spark.createDataFrame(rows, "name string, shape array<int>, data array<double>").coalesce(1) \
            .write.mode("overwrite").parquet(f"{path}/arrays")
        spark.createDataFrame([(json.dumps(meta),)], "metadata string").coalesce(1) \
            .write.mode("overwrite").json(f"{path}/metadata")


class UserModel(Detector):
    """Any function from a pandas frame of features to scores as a detector: it explains, permutes and scores like the others.

    ``decision`` says that the function is a signed decision (negative is anomalous) rather than a score that grows with
    the anomaly; ``threshold`` is where it flags. Such a model can't be saved.
    """

    kind = "user"

    def __init__(self, function: Callable[[pd.DataFrame], pd.Series], features: list[str], threshold: float = 0.0,
                 decision: bool = False, scaler: FlowScalerModel | None = None):
        self.function, self.features, self.threshold, self.scaler = function, list(features), float(threshold), scaler
        self.higher_is_worse = not decision

    def matrix_score(self) -> Callable[[np.ndarray], np.ndarray]:
        function, features = self.function, self.features
        return lambda rows: np.asarray(function(pd.DataFrame(rows, columns=features)), dtype=float)

    def prediction(self, raw: Column) -> Column:
        return (raw > self.threshold if self.higher_is_worse else raw < self.threshold).cast("int")

    def probability(self, raw: Column) -> Column:
        distance = raw - F.lit(self.threshold)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-distance if self.higher_is_worse else distance))

    def metadata(self) -> dict:
        return {"features": self.features}

    def arrays(self) -> dict[str, np.ndarray]:
        return {}

    def save(self, spark: SparkSession, path: str) -> None:
        raise TypeError("a user function has no state to save")


def read_state(spark: SparkSession, path: str) -> tuple[dict, dict[str, np.ndarray]]:
    meta = json.loads(spark.read.schema("metadata string").json(f"{path}/metadata").first()[0])
    arrays = {r["name"]: np.array(r["data"], dtype=float).reshape(r["shape"])
              for r in spark.read.parquet(f"{path}/arrays").collect()}
    return meta, arrays


def restore_common(model: Detector, meta: dict) -> Detector:
    model.features, model.threshold = list(meta["features"]), float(meta["threshold"])
    scaler = meta["scaler"]
    model.scaler = None if scaler is None else FlowScalerModel([tuple(t) for t in scaler[1]], scaler[0])
    return model
