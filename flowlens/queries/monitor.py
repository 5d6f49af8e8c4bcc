"""Prediction log, monitoring and streaming queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.detect import registry
from flowlens.operators import monitor
from flowlens.queries.detect import LINEAR_SCORE, SCALED, SCORED_SQL, THREE, _linear_svm, _three
from flowlens.queries.registry import KEYS, SIGNAL, query, r, rounded
from flowlens.session import scratch_path
from flowlens.sources import prediction_log as plog
from flowlens.sources import views
from flowlens.sources.views import FLOW_KEYS
from flowlens.streaming.monitor import drift_log, stream_statistics
from flowlens.streaming.scoring import score_stream
from flowlens.streaming.sinks import drain_to_table, latest

LOG = """log as (select event_id, ts as "timestamp", case when event_type = 'error' then 1 else 0 end as prediction,
  value as anomaly_score, least(value / 100.0, 1.0) as confidence,
  case when user_id < 50 then 'ocsvm' when user_id < 100 then 'vae' else 'forest' end as model_used,
  json_extract_string(props, '$.k')::double as k, value, props from events)"""
RECORD = """epoch_us("timestamp") as micros, prediction, anomaly_score, """ + r("confidence", 6, "confidence") + \
    ", model_used, k as inference_time_ms, value as feature_value, k as feature_k, props as metadata"


def _record(log):
    return rounded(log.select(
        F.unix_micros(F.col("timestamp").cast("timestamp")).alias("micros"), "prediction", "anomaly_score", "confidence",
        "model_used", "inference_time_ms", F.col("features")["value"].alias("feature_value"),
        F.col("features")["k"].alias("feature_k"), "metadata"))


def _log_with_time(spark, sf_dir):
    return views.prediction_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))


@query("s3_read_log", f"with {LOG} select {RECORD} from log")
def s3(spark, sf_dir):
    path = scratch_path(spark, "log")
    plog.write_prediction_log(_log_with_time(spark, sf_dir).select(*plog.LOG_COLUMNS), path)
    return _record(plog.read_prediction_log(spark, path))


@query("s4_write_log", f"""with {SCALED}, {SCORED_SQL} select prediction, {r("-raw", 6, "anomaly_score")},
  {r("confidence", 4, "confidence")}, 'svm' as model_used, 2.5::double as inference_time_ms, flow_duration,
  iat_mean from reported""")
def s4(spark, sf_dir):
    df = _three(spark, sf_dir)
    scored = registry.score_flows(df, _linear_svm(df))
    path = scratch_path(spark, "scored-log")
    plog.write_prediction_log(plog.to_log(scored, "svm", THREE, inference_time_ms=F.lit(2.5)), path)
    log = plog.read_prediction_log(spark, path)
    return rounded(log.select("prediction", "anomaly_score", "confidence", "model_used", "inference_time_ms",
                              F.col("features")["flow_duration"].alias("flow_duration"),
                              F.col("features")["iat_mean"].alias("iat_mean")), 6, confidence=4)


@query("s5_export_logs", f"""with {LOG} select event_id, prediction, anomaly_score, model_used,
  k as inference_time_ms from log""")
def s5(spark, sf_dir):
    path = scratch_path(spark, "export")
    plog.export_logs(_log_with_time(spark, sf_dir), path, "csv")
    back = spark.read.option("header", True).csv(path)
    return back.select(F.col("event_id").cast("bigint"), F.col("prediction").cast("int"),
                       F.col("anomaly_score").cast("double"), "model_used", F.col("inference_time_ms").cast("double"))


@query("s6_write_results", f"""with {SIGNAL} select label, count(*) as flows, {r("avg(total_bytes)", 4, "mean_bytes")}
  from signal group by label""")
def s6(spark, sf_dir):
    from flowlens.sources.results import write_results

    folder = scratch_path(spark, "results")
    table = views.flows_signal(spark, sf_dir).groupBy("label").agg(
        F.count("*").alias("flows"), F.avg("total_bytes").alias("mean_bytes"))
    write_results({"by_label": table}, folder, "csv")
    back = spark.read.option("header", True).schema("label string, flows bigint, mean_bytes double").csv(
        f"{folder}/by_label")
    return rounded(back, 4)


STATISTICS = """count(*) as total_predictions, count(*) filter (prediction = 1) as total_anomalies"""


@query("k1_statistics", f"""with {LOG}, newest as (select prediction from log order by "timestamp" desc, event_id desc limit 1000)
  select {STATISTICS}, {r("count(*) filter (prediction = 1) * 100.0 / count(*)", 6, "anomaly_rate_percent")},
  {r("(select avg(prediction) * 100 from newest)", 6, "recent_anomaly_rate_percent")},
  {r("avg(k)", 6, "avg_inference_time_ms")}, {r("sum(k)", 3, "total_inference_time_ms")},
  (select count(*) from newest) as history_window_size from log""")
def k1(spark, sf_dir):
    log = views.prediction_log(spark, sf_dir)
    return rounded(monitor.statistics(log, ["timestamp", "event_id"]), 6, total_inference_time_ms=3)


@query("k2_recent_window", f"""with {LOG} select event_id, count(*) over w as window_size,
  {r("avg(prediction) over w * 100", 6, "recent_anomaly_rate_percent")} from log
  window w as (order by "timestamp", event_id rows between 999 preceding and current row)""")
def k2(spark, sf_dir):
    log = views.prediction_log(spark, sf_dir).select("event_id", "timestamp", "prediction")
    out = monitor.recent_rate(log, ["timestamp", "event_id"])
    return rounded(out.select("event_id", "window_size", "recent_anomaly_rate_percent"))


def _drift_ctes(scale: str, shift: float = 0.0) -> str:
    return f"""{LOG}, half as (select median(epoch_us("timestamp")) as m from log),
  long_log as (select "timestamp", 'value' as feature, value as v from log
    union all select "timestamp", 'k', k from log),
  baseline as (select feature, avg(v) - {shift} as train_mean, stddev_pop(v) as train_std from long_log
    where "timestamp" < timestamp '2024-01-16 00:00:00' group by feature),
  now_ as (select feature, avg(v) as mean, stddev_pop(v) as std, count(*) as samples from long_log
    where "timestamp" >= timestamp '2024-01-16 00:00:00' group by feature),
  drift as (select n.feature, mean, std, samples, train_mean, train_std,
    abs(mean - train_mean) / ({scale} + 1e-10) as mean_drift,
    abs(std - train_std) / (train_std + 1e-10) as std_drift from now_ n join baseline b on n.feature = b.feature)"""


def _halves(spark, sf_dir, shift=0.0):
    log = _log_with_time(spark, sf_dir)
    cut = F.lit("2024-01-16 00:00:00").cast("timestamp")
    baseline = monitor.map_moments(log.where(F.col("timestamp") < cut)).withColumn("mean", F.col("mean") - shift)
    return monitor.map_moments(log.where(F.col("timestamp") >= cut)), baseline


DRIFT_COLUMNS = ", ".join([r("mean", 6, "mean"), r("std", 6, "std"), r("mean_drift", 6, "mean_drift"),
                           r("std_drift", 6, "std_drift")])


@query("k3_drift_table", f"""with {_drift_ctes('train_mean')} select feature, samples, {DRIFT_COLUMNS},
  mean_drift > 0.2 as mean_drifted, std_drift > 0.2 as std_drifted from drift""")
def k3(spark, sf_dir):
    current, baseline = _halves(spark, sf_dir)
    return rounded(monitor.drift_table(current, baseline).select(
        "feature", "samples", "mean", "std", "mean_drift", "std_drift", "mean_drifted", "std_drifted"))


RECORD_COLUMNS = ["drift_detected", "n_samples_checked", "threshold", "n_features_drift_mean", "n_features_drift_std",
                  "max_mean_drift", "max_std_drift", "features_mean", "features_std"]
DRIFT_RECORD = f"""select count(*) filter (mean_drift > 0.2) + count(*) filter (std_drift > 0.2) > 0 as drift_detected,
  max(samples) as n_samples_checked, 0.2::double as threshold,
  count(*) filter (mean_drift > 0.2)::integer as n_features_drift_mean,
  count(*) filter (std_drift > 0.2)::integer as n_features_drift_std, {r("max(mean_drift)", 6, "max_mean_drift")},
  {r("max(std_drift)", 6, "max_std_drift")},
  coalesce(string_agg(feature, ',' order by feature) filter (mean_drift > 0.2), '') as features_mean,
  coalesce(string_agg(feature, ',' order by feature) filter (std_drift > 0.2), '') as features_std from drift"""


def _record_of(drift):
    return rounded(drift.withColumns({
        "features_mean": F.concat_ws(",", "drift_features_mean"),
        "features_std": F.concat_ws(",", "drift_features_std")}).select(*RECORD_COLUMNS))


@query("k3_check_drift", f"with {_drift_ctes('train_mean', 20.0)} {DRIFT_RECORD}")
def k3_record(spark, sf_dir):
    current, baseline = _halves(spark, sf_dir, 20.0)
    return _record_of(monitor.check_drift(spark, current, baseline))


@query("k4_drift_negative_mean", f"with {_drift_ctes('train_mean', 1000.0)} {DRIFT_RECORD}")
def k4(spark, sf_dir):
    current, baseline = _halves(spark, sf_dir, 1000.0)
    return _record_of(monitor.check_drift(spark, current, baseline))


@query("k4_drift_absolute", f"with {_drift_ctes('abs(train_mean)', 1000.0)} {DRIFT_RECORD}")
def k4_abs(spark, sf_dir):
    current, baseline = _halves(spark, sf_dir, 1000.0)
    return _record_of(monitor.check_drift(spark, current, baseline, mode="abs"))


@query("k5_no_baseline", f"""with {LOG} select false as drift_detected, 'No training statistics available' as message
  from log having count(*) > 0""")
def k5(spark, sf_dir):
    current, _ = _halves(spark, sf_dir)
    return monitor.check_drift(spark, current, None).select("drift_detected", "message")


BUCKETS = f"""{LOG}, long_log as (select "timestamp", 'value' as feature, value as v from log
    union all select "timestamp", 'k', k from log),
  baseline as (select feature, avg(v) as train_mean, stddev_pop(v) as train_std from long_log group by feature),
  buckets as (select date_trunc('day', "timestamp") as bucket, feature, avg(v) as mean, stddev_pop(v) as std,
    count(*) as samples from long_log group by all)
  select epoch_us(bucket) as bucket_micros, b.feature, samples, {r("mean", 6, "mean")},
  {r("abs(mean - train_mean) / (train_mean + 1e-10)", 6, "mean_drift")},
  {r("abs(std - train_std) / (train_std + 1e-10)", 6, "std_drift")} from buckets b join baseline using (feature)"""


def _bucket_columns(table):
    return rounded(table.select(F.unix_micros("bucket_start").alias("bucket_micros"), "feature", "samples", "mean",
                                "mean_drift", "std_drift"))


@query("k8_drift_by_day", f"with {BUCKETS}")
def k8(spark, sf_dir):
    log = _log_with_time(spark, sf_dir)
    return _bucket_columns(monitor.drift_by_bucket(log, monitor.map_moments(log)))


@query("k8_drift_by_day_stream", f"with {BUCKETS}")
def k8_stream(spark, sf_dir):
    baseline = monitor.map_moments(_log_with_time(spark, sf_dir))
    log = views.log_of(views.stream(spark, sf_dir, "events")).withColumn(
        "timestamp", F.col("timestamp").cast("timestamp"))
    table, _ = drain_to_table(monitor.drift_by_bucket(log, baseline, watermark="1 hour"), output_mode="update")
    return _bucket_columns(latest(table, ["bucket_start", "feature"]))


@query("k1_stream_statistics", f"""with {LOG}, newest as (select *, row_number() over (partition by model_used
    order by "timestamp" desc, event_id desc) as n from log)
  select model_used, {STATISTICS}, {r("count(*) filter (prediction = 1) * 100.0 / count(*)", 6, "anomaly_rate_percent")},
  count(*) filter (n <= 1000) as history_window_size,
  {r("count(*) filter (n <= 1000 and prediction = 1) * 100.0 / count(*) filter (n <= 1000)", 6,
     "recent_anomaly_rate_percent")}, {r("avg(k)", 6, "avg_inference_time_ms")} from newest group by model_used""")
def k1_stream(spark, sf_dir):
    log = views.log_of(views.stream(spark, sf_dir, "events"))
    return rounded(stream_statistics(log, "event_id").drop("total_inference_time_ms"))


@query("k6_drift_log", f"""with {LOG}, long_log as (select 'value' as feature, value as v from log
    union all select 'k', k from log),
  drift as (select feature, count(*) as samples, 20 / (avg(v) - 20 + 1e-10) as mean_drift, 0.0 as std_drift from long_log
    group by feature)
  select max(samples) as n_samples_checked, count(*) filter (mean_drift > 0.2)::integer as n_features_drift_mean,
  {r("max(mean_drift)", 6, "max_mean_drift")} from drift""")
def k6(spark, sf_dir):
    baseline = monitor.map_moments(views.prediction_log(spark, sf_dir)).withColumn("mean", F.col("mean") - 20.0)
    log = views.log_of(views.stream(spark, sf_dir, "events"))
    return rounded(drift_log(log, baseline).select("n_samples_checked", "n_features_drift_mean", "max_mean_drift"))


@query("k7_streaming_scores", f"""with {SCALED}, scores as (select *, {LINEAR_SCORE} as raw from scaled)
  select {KEYS}, case when raw < 0 then 1 else 0 end as prediction, {r("-raw", 6, "anomaly_score")},
  'svm' as model_used, flow_duration from scores""")
def k7(spark, sf_dir):
    model = _linear_svm(_three(spark, sf_dir))
    stream = views.signal_of(views.flows_of(views.stream(spark, sf_dir, "lineitem")))
    table, _ = drain_to_table(score_stream(stream, model, "svm", keep=FLOW_KEYS))
    return rounded(table.select(*FLOW_KEYS, "prediction", "anomaly_score", "model_used",
                                F.col("features")["flow_duration"].alias("flow_duration")))
