"""Statistics of the prediction log and drift of its features (K1-K5, K8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.functions.numeric import long_form, null_if_nan, ratio
from flowlens.operators.ordering import trailing

HISTORY = 1_000         # fixed value: predictions that count as recent
DRIFT_THRESHOLD = 0.20  # fixed value
EPSILON = 1e-10         # fixed value
# Message texts.
NO_BASELINE = "No training statistics available"
NO_HISTORY = "No predictions logged yet"


def statistics(log: DataFrame, order: list[str], history: int = HISTORY) -> DataFrame:
    """K1: totals, anomaly rate, rate over the most recent predictions, inference time; zeros for an empty log.

    The recent rows come from a top-n that keeps ``history`` rows per task, not from a sort of the log.
    """
    recent = log.orderBy(*[F.col(c).desc() for c in order]).limit(history).agg(
        F.count("*").alias("n"), F.count_if(F.col("prediction") == 1).alias("anomalies"))
    total, anomalies = F.col("total_predictions"), F.col("total_anomalies")
    return log.agg(
        F.count("*").alias("total_predictions"),
        F.count_if(F.col("prediction") == 1).alias("total_anomalies"),
        F.coalesce(F.sum("inference_time_ms"), F.lit(0.0)).alias("total_inference_time_ms"),
    ).select(
        total, anomalies, ratio(anomalies * 100.0, total).alias("anomaly_rate_percent"),
        recent.select(ratio(F.col("anomalies") * 100.0, F.col("n"))).scalar().alias("recent_anomaly_rate_percent"),
        ratio(F.col("total_inference_time_ms"), total).alias("avg_inference_time_ms"), "total_inference_time_ms",
        recent.select("n").scalar().alias("history_window_size"),
    )


def recent_rate(log: DataFrame, order: list[str], history: int = HISTORY, block: int = 100_000) -> DataFrame:
    """K2: for every record, number and anomaly rate of the last ``history`` records up to it."""
    flag = F.when(F.col("prediction") == 1, 100.0).otherwise(0.0)
    return trailing(log, [F.col(c).asc() for c in order], history, {
        "window_size": F.count("*"), "recent_anomaly_rate_percent": F.avg(flag)}, block)


def map_moments(log: DataFrame, features: str = "features", by: list[Column] | None = None) -> DataFrame:
    """Mean, population deviation and count per feature of a map column, optionally per group."""
    by = by or []
    long = log.select(*by, F.explode(features).alias("feature", "value"))
    names = [n for n in long.columns if n not in ("feature", "value")]
    return _moments(long, names)


def column_moments(df: DataFrame, features: list[str], by: list[str] | None = None) -> DataFrame:
    """The same for feature columns."""
    return _moments(long_form(df, features, *(by or [])), by or [])


def _moments(long: DataFrame, by: list[str]) -> DataFrame:
    value = null_if_nan(F.col("value"))
    return long.groupBy(*by, "feature").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("samples"))


def drift_table(current: DataFrame, baseline: DataFrame, threshold: float = DRIFT_THRESHOLD,
                mode: str = "reference") -> DataFrame:
    """K3/K4: relative change of mean and deviation per feature; a change equal to the threshold is no drift.

    ``reference`` divides by the signed baseline mean, under which a feature of negative mean never drifts; ``abs``
    divides by its absolute value. A baseline without mean or deviation counts as 0 or 1.
    """
    if mode not in ("reference", "abs"):
        raise ValueError("mode is 'reference' or 'abs'")
    train = baseline.select("feature", F.coalesce("mean", F.lit(0.0)).alias("train_mean"),
                            F.coalesce("std", F.lit(1.0)).alias("train_std"))
    scale = F.abs("train_mean") if mode == "abs" else F.col("train_mean")
    joined = current.join(train, "feature", "left").fillna({"train_mean": 0.0, "train_std": 1.0})
    mean_drift = F.abs(F.col("mean") - F.col("train_mean")) / (scale + EPSILON)
    std_drift = F.abs(F.col("std") - F.col("train_std")) / (F.col("train_std") + EPSILON)
    return joined.withColumns({"mean_drift": mean_drift, "std_drift": std_drift}).withColumns({
        "mean_drifted": F.col("mean_drift") > threshold, "std_drifted": F.col("std_drift") > threshold})


def drift_summary(table: DataFrame, threshold: float = DRIFT_THRESHOLD, by: list[str] | None = None,
                  features: list[str] | None = None) -> DataFrame:
    """K3: one record (per group): counts, maxima and names of the drifted features; with ``features`` also indices."""
    by = by or []

    def names(flag: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col(flag), F.col("feature"))))

    out = table.groupBy(*by).agg(
        F.coalesce(F.max("samples"), F.lit(0)).cast("bigint").alias("n_samples_checked"),
        F.count_if("mean_drifted").cast("int").alias("n_features_drift_mean"),
        F.count_if("std_drifted").cast("int").alias("n_features_drift_std"),
        F.max("mean_drift").alias("max_mean_drift"), F.max("std_drift").alias("max_std_drift"),
        names("mean_drifted").alias("drift_features_mean"), names("std_drifted").alias("drift_features_std"),
    )
    out = out.select(
        *by, (F.col("n_features_drift_mean") + F.col("n_features_drift_std") > 0).alias("drift_detected"),
        F.current_timestamp().alias("timestamp"), F.lit(float(threshold)).alias("threshold"),
        *[c for c in out.columns if c not in by],
        F.when(F.col("n_samples_checked") == 0, NO_HISTORY).alias("message"))
    if features:
        order = F.array(*[F.lit(f) for f in features])
        out = out.withColumns({f"{c}_index": F.transform(c, lambda n: (F.array_position(order, n) - 1).cast("int"))
                               for c in ("drift_features_mean", "drift_features_std")})
    return out


def check_drift(spark: SparkSession, current: DataFrame, baseline: DataFrame | None,
                threshold: float = DRIFT_THRESHOLD, mode: str = "reference",
                features: list[str] | None = None) -> DataFrame:
    """K3/K5: the drift record of ``current`` (feature moments); without a baseline a record that says so."""
    if baseline is None:
        empty = spark.createDataFrame([], "feature string, mean double, std double")
        table = drift_table(current.limit(0), empty, threshold, mode)
        return drift_summary(table, threshold, features=features).withColumn("message", F.lit(NO_BASELINE))
    return drift_summary(drift_table(current, baseline, threshold, mode), threshold, features=features)


def drift_by_bucket(log: DataFrame, baseline: DataFrame, duration: str = "1 day", time: str = "timestamp",
                    features: str = "features", threshold: float = DRIFT_THRESHOLD, mode: str = "reference",
                    watermark: str | None = None) -> DataFrame:
    """K8: the drift table per event-time window; the same plan serves a table and (with a watermark) a stream."""
    if watermark:
        log = log.withWatermark(time, watermark)
    exploded = log.select(time, F.explode(features).alias("feature", "value"))
    value = null_if_nan(F.col("value"))
    moments = exploded.groupBy(F.window(time, duration).alias("bucket"), "feature").agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("samples"))
    return drift_table(moments, baseline, threshold, mode).withColumn(
        "bucket_start", F.col("bucket.start")).drop("bucket")
