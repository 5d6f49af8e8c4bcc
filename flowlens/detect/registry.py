"""Saved models by name, scoring by name and the batch scoring pipeline."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.detect.autoencoder import AutoencoderModel
from flowlens.detect.base import Detector, read_state, restore_common
from flowlens.detect.forest import IsolationForestModel
from flowlens.detect.ocsvm import OneClassSVMModel
from flowlens.detect.vae import VariationalAutoencoderModel
from flowlens.functions.numeric import INF
from flowlens.operators.schema import explanation_text, label_text

KINDS = {c.kind: c for c in (IsolationForestModel, OneClassSVMModel, AutoencoderModel, VariationalAutoencoderModel)}


def load_model(spark: SparkSession, path: str) -> Detector:
    """A detector from its parquet parts."""
    meta, arrays = read_state(spark, path)
    model = restore_common(KINDS[meta["kind"]].restore(meta["model"], arrays), meta)
    return model.finish() if isinstance(model, OneClassSVMModel) else model


class ModelRegistry:
    """Loads what exists; the default is the one-class SVM, else the first model that loaded."""

    def __init__(self, spark: SparkSession, catalog: dict[str, str]):
        self.spark, self.catalog = spark, dict(catalog)
        self.models: dict[str, Detector] = {}
        self.status: dict[str, str] = {}
        for name, path in self.catalog.items():
            try:
                self.models[name] = load_model(spark, path)
                self.status[name] = "loaded"
            except (AnalysisException, FileNotFoundError) as error:
                self.status[name] = f"missing: {type(error).__name__}"

    @property
    def default(self) -> str | None:
        for name, model in self.models.items():
            if model.kind == "one_class_svm":
                return name
        return next(iter(self.models), None)

    def get(self, name: str | None = None) -> Detector:
        name = name or self.default
        if name not in self.models:
            raise ValueError(f"model '{name}' is not loaded; available: {', '.join(self.models) or 'none'}")
        return self.models[name]

    def to_frame(self) -> DataFrame:
        rows = [(n, self.models[n].kind if n in self.models else None, p, n in self.models, self.status[n],
                 n == self.default) for n, p in self.catalog.items()]
        return self.spark.createDataFrame(
            rows, "name string, kind string, path string, loaded boolean, status string, is_default boolean")

    def score_with(self, df: DataFrame, name: str | None = None) -> DataFrame:
        chosen = name or self.default
        return score_with(df, self.get(chosen), chosen)


def decision_confidence(raw: Column) -> Column:
    """Half the distance from the boundary, at most 1."""
    return F.least(F.abs(raw) / 2.0, F.lit(1.0))


def percent_confidence(raw: Column) -> Column:
    """The distance from the boundary in percent, between 0 and 100."""
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.abs(raw) * 100.0))


def score_with(df: DataFrame, model: Detector, name: str) -> DataFrame:
    """Prediction, scores and confidence of one model. Models with a signed decision use its distance."""
    scored = model.transform(df)
    confidence = F.col("anomaly_probability") if model.higher_is_worse else decision_confidence(F.col("raw_score"))
    return scored.withColumns({"model": F.lit(name), "confidence": confidence})


def score_flows(df: DataFrame, model: Detector, top_feature: Column | None = None, strict: bool = True) -> DataFrame:
    """The whole scoring pipeline as one projection; batch and streaming frames share it.

    A frame without one of the model's features is refused before any job (P7). With ``strict=False`` an absent column is
    0.0 (P5), and a row whose features are missing or infinite becomes ``ERROR`` with score and confidence 0.
    """
    absent = [] if strict else [f for f in model.features if f not in df.columns]
    scored = model.transform(df.withColumns({f: F.lit(0.0) for f in absent}) if absent else df)
    raw = F.col("raw_score")
    confidence = percent_confidence(raw)
    feature = top_feature if top_feature is not None else F.lit("unknown")
    broken = F.lit(False)
    if not strict:
        for f in model.features:
            broken = broken | F.col(f).isNull() | (F.abs(F.col(f).cast("double")) >= F.lit(INF))
    out = scored.withColumns({
        "confidence": F.when(broken, F.lit(0.0)).otherwise(confidence),
        "prediction_label": F.when(broken, F.lit("ERROR")).otherwise(label_text(F.col("prediction"))),
        "explanation": F.when(broken, F.lit("row could not be scored")).otherwise(
            explanation_text(F.col("prediction"), feature, confidence)),
    })
    if strict:
        return out
    return out.withColumns({
        "prediction": F.when(broken, F.lit(None).cast("int")).otherwise(F.col("prediction")),
        "raw_score": F.when(broken, F.lit(0.0)).otherwise(raw),
        "anomaly_score": F.when(broken, F.lit(0.0)).otherwise(F.col("anomaly_score")),
    }).drop(*absent)
