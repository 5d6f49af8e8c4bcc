"""Monitoring a stream of predictions: running totals, the recent window, drift log (K1, K2, K6, K8)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from flowlens.functions.numeric import ratio
from flowlens.operators.monitor import HISTORY, check_drift, map_moments
from flowlens.operators.ordering import newest
from flowlens.session import scratch_path
from flowlens.streaming.sinks import drain_to_table, latest

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SALTS = 16


def running_totals(log: DataFrame, by: str = "model_used") -> DataFrame:
    """K1 totals per model as a streaming aggregate; partial counts are combined before the shuffle."""
    return log.groupBy(by).agg(
        F.count("*").alias("total_predictions"), F.count_if(F.col("prediction") == 1).alias("total_anomalies"),
        F.sum("inference_time_ms").alias("total_inference_time_ms"))


class RecentRows(StatefulProcessor):
    """Keeps the newest ``size`` (time, id) pairs of a key and passes on rows that enter them."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", T.StructType([
            T.StructField("micros", T.ArrayType(T.LongType())), T.StructField("ids", T.ArrayType(T.LongType()))]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = pd.DataFrame({"micros": [], "id": []}, dtype="int64")
        if self.newest.exists():
            state = self.newest.get()
            known = pd.DataFrame({"micros": list(state[0]), "id": list(state[1])}, dtype="int64")
        known["prediction"], known["fresh"] = 0, False
        for batch in rows:
            batch = batch[["micros", "id", "prediction"]].assign(fresh=True)
            known = pd.concat([known, batch]).sort_values(["micros", "id"], ascending=False).head(self.size)
        self.newest.update((known["micros"].astype("int64").tolist(), known["id"].astype("int64").tolist()))
        fresh = known[known["fresh"].astype(bool)]
        if len(fresh):
            yield pd.DataFrame({"model_used": key[0], "micros": fresh["micros"].astype("int64"),
                                "id": fresh["id"].astype("int64"), "prediction": fresh["prediction"].astype("int32")})

    def close(self) -> None:
        pass


def recent_candidates(log: DataFrame, id_column: str, time: str = "timestamp", size: int = HISTORY,
                      salts: int = SALTS) -> DataFrame:
    """K2 on a stream: per model, rows that were among the newest ``size`` when they arrived.

    The state is keyed by (model, salt), so one busy model is spread over many tasks; each key holds ``size`` pairs.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    keyed = log.select("model_used", F.unix_micros(F.col(time).cast("timestamp")).alias("micros"),
                       F.col(id_column).cast("bigint").alias("id"), "prediction",
                       F.pmod(F.xxhash64(id_column), F.lit(salts)).cast("int").alias("salt"))
    return keyed.groupBy("model_used", "salt").transformWithStateInPandas(
        RecentRows(size), "model_used string, micros bigint, id bigint, prediction int", "Append", "none")


def recent_rows(candidates: DataFrame, size: int = HISTORY, salts: int = SALTS) -> DataFrame:
    """The newest ``size`` rows per model out of the drained candidates, first of every share of a model, then of those."""
    return newest(candidates, ["model_used"], [F.col("micros").desc(), F.col("id").desc()], size, salts, "id")


def stream_statistics(log: DataFrame, id_column: str, size: int = HISTORY, salts: int = SALTS) -> DataFrame:
    """K1 per model from two drained streams: totals (update mode) and the recent window; ``salts`` tasks share a model."""
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    totals, _ = drain_to_table(running_totals(log), output_mode="update")
    candidates, _ = drain_to_table(recent_candidates(log, id_column, size=size, salts=salts))
    recent = recent_rows(candidates, size, salts).groupBy("model_used").agg(
        F.count("*").alias("history_window_size"),
        ratio(F.count_if(F.col("prediction") == 1) * 100.0, F.count("*")).alias("recent_anomaly_rate_percent"))
    return latest(totals, ["model_used"]).join(recent, "model_used").withColumns({
        "anomaly_rate_percent": ratio(F.col("total_anomalies") * 100.0, F.col("total_predictions")),
        "avg_inference_time_ms": ratio(F.col("total_inference_time_ms"), F.col("total_predictions"))})


def drift_log(log: DataFrame, baseline: DataFrame, features: list[str] | None = None,
              path: str | None = None) -> DataFrame:
    """K6: a drift record per micro-batch, kept only when drift was found."""
    spark: SparkSession = log.sparkSession
    path = path or scratch_path(spark, "drift-log")

    def records(batch: DataFrame) -> DataFrame:
        return check_drift(batch.sparkSession, map_moments(batch), baseline, features=features).where("drift_detected")

    return drain_to_table(log, path=path, transform=records)[0]
