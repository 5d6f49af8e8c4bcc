"""Scoring a stream of flows into the prediction log (K7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from flowlens.detect.base import Detector
from flowlens.detect.registry import score_flows
from flowlens.sources.prediction_log import to_log


def score_stream(flows: DataFrame, model: Detector, name: str, keep: list[str] | None = None,
                 top_feature: Column | None = None, strict: bool = True) -> DataFrame:
    """The scoring projection of the batch path, followed by the log projection; no state, no shuffle."""
    scored = score_flows(flows, model, top_feature, strict)
    return to_log(scored, name, model.features, keep=keep)
