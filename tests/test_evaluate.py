"""Edge rules of metrics, ordering, monitoring and streams."""

import json
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.detect.ocsvm import OneClassSVM
from flowlens.operators import labels, metrics, monitor, ordering
from flowlens.operators.ordering import trailing, with_position
from flowlens.operators.schema import recode_prediction
from flowlens.plans import training
from flowlens.sources import prediction_log as plog
from flowlens.sources.flows import read_days
from flowlens.streaming.monitor import recent_rows, stream_statistics
from flowlens.streaming.sinks import drain_to_table, late_rows

# Published grid of one-class SVM runs (nu, kernel, gamma, F1, precision, recall).
GRID = [
    (0.001, "rbf", "scale", 0.8013, 0.9684, 0.6834), (0.001, "rbf", "auto", 0.8013, 0.9684, 0.6834),
    (0.001, "linear", None, 0.2112, 0.1742, 0.2683), (0.001, "poly", None, 0.1747, 0.8971, 0.0968),
    (0.005, "rbf", "scale", 0.8526, 0.9629, 0.7650), (0.005, "rbf", "auto", 0.8526, 0.9629, 0.7650),
    (0.005, "linear", None, 0.1031, 0.0963, 0.1110), (0.005, "poly", None, 0.1557, 0.7806, 0.0865),
    (0.010, "rbf", "scale", 0.8528, 0.9467, 0.7759), (0.010, "rbf", "auto", 0.8528, 0.9467, 0.7759),
    (0.010, "linear", None, 0.0115, 0.0187, 0.0083), (0.010, "poly", None, 0.1456, 0.6977, 0.0813),
    (0.020, "rbf", "scale", 0.8540, 0.9236, 0.7942), (0.020, "rbf", "auto", 0.8540, 0.9236, 0.7942),
]


def scored(spark, rows):
    return spark.createDataFrame(rows, "model string, label int, label_original string, prediction int, "
                                       "anomaly_score double")


def test_one_class_only_gives_zeros_not_errors(spark):
    df = scored(spark, [("m", 0, "BENIGN", 0, 0.1), ("m", 0, "BENIGN", 1, 0.9)])
    r = metrics.classification_metrics(df, ["model"]).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"]) == (0, 1, 1, 0)
    assert r["precision"] == r["recall"] == r["f1"] == r["fnr"] == 0.0 and r["fpr"] == 0.5
    assert metrics.auc(df, ["model"]).first()["auc"] == 0.0
    empty = metrics.classification_metrics(df.limit(0)).first()
    assert empty["accuracy"] == 0.0


def test_auc_equals_pair_count_with_ties(spark):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 30, 400).astype(float)
    df = scored(spark, [("m", int(a), "x", 0, float(b)) for a, b in zip(y, s)]).repartition(6)
    wins = sum((p > q) + 0.5 * (p == q) for p in s[y == 1] for q in s[y == 0]) / ((y == 1).sum() * (y == 0).sum())
    assert metrics.auc(df, ["model"]).first()["auc"] == pytest.approx(wins)
    points = sorted((r["fpr"], r["tpr"]) for r in metrics.roc_points(df, ["model"]).collect())
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))
    assert area == pytest.approx(wins) and points[0] == (0, 0) and points[-1] == (1, 1)


def test_per_attack_counts_missing_labels_and_leaves_out_benign(spark):
    df = scored(spark, [("m", 1, "DoS", 1, 1.0), ("m", 1, "DoS", 0, 0.0), ("m", 0, "BENIGN", 1, 1.0),
                        ("m", 1, None, 0, 0.0)])
    got = {r["attack_type"]: r for r in metrics.per_attack(df).collect()}
    assert set(got) == {"DoS", None} and got["DoS"]["detection_rate"] == 0.5 and got["DoS"]["precision"] == 1.0
    assert got[None]["f1"] == 0.0


def test_winner_ties_go_to_the_second_model(spark):
    rated = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 0.5)], "scenario string, model string, f1 double")
    assert metrics.scenario_summary(rated, "a", "b").first()["winner"] == "b"


def test_gates_use_at_least(spark):
    rated = spark.createDataFrame([("a", 0.85), ("b", 0.8499)], "model string, f1 double")
    assert {r["model"]: r["gate"] for r in metrics.quality_gate(rated).collect()} == {"a": "PASS", "b": "FAIL"}


def test_grid_analysis_of_published_rows(spark):
    grid = spark.createDataFrame(GRID, "nu double, kernel string, gamma string, f1 double, precision double, "
                                       "recall double")
    out = metrics.grid_analysis(grid)
    assert {r["kernel"]: r["best_f1"] for r in out["best_by_parameter"].collect()} == {
        "rbf": 0.8540, "linear": 0.2112, "poly": 0.1747}
    assert out["best_by_both"].count() == 10
    assert [r["f1"] for r in out["top"].collect()] == [0.8540, 0.8540, 0.8528, 0.8528, 0.8526]


def test_prediction_recode(spark):
    df = spark.createDataFrame([(-1,), (1,)], "raw int")
    assert [r[0] for r in df.select(recode_prediction(F.col("raw"))).collect()] == [1, 0]


def test_global_positions_and_trailing_window(spark):
    df = spark.range(2000).select("id", F.pmod(F.col("id") * 7, F.lit(13)).cast("int").alias("v")).repartition(5)
    placed = with_position(df, [F.col("v").asc(), F.col("id").asc()]).collect()
    expected = sorted(placed, key=lambda r: (r["v"], r["id"]))
    assert [r["position"] for r in expected] == list(range(2000))
    rolled = trailing(df, [F.col("id").asc()], 100, {"s": F.sum("v"), "n": F.count("*")}, block=300).collect()
    v = [7 * i % 13 for i in range(2000)]
    for r in rolled:
        window = v[max(0, r["id"] - 99):r["id"] + 1]
        assert (r["s"], r["n"]) == (sum(window), len(window))


# ---- monitoring ----------------------------------------------------------------------------------------------------

def smoke_log(spark):
    """Ten predictions, every third an anomaly."""
    rows = [(i, i % 3 == 0) for i in range(10)]
    return spark.createDataFrame([(i, int(a), 0.8 if a else 0.2, 0.9, "svm", 2.5) for i, a in rows],
                                 "id long, prediction int, anomaly_score double, confidence double, model_used string, "
                                 "inference_time_ms double").select(
        "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("timestamp"), "prediction", "anomaly_score",
        "confidence", "model_used", "inference_time_ms",
        F.create_map(F.lit("x"), F.col("id").cast("double")).alias("features"), F.lit('{"k": 1}').alias("metadata"))


def test_statistics_of_the_smoke_sequence(spark):
    log = smoke_log(spark)
    r = monitor.statistics(log, ["timestamp", "id"]).first()
    assert (r["total_predictions"], r["total_anomalies"]) == (10, 4)
    assert r["anomaly_rate_percent"] == 40.0 and r["avg_inference_time_ms"] == 2.5
    assert r["history_window_size"] == 10
    last = monitor.statistics(log, ["timestamp", "id"], history=3).first()
    assert last["recent_anomaly_rate_percent"] == pytest.approx(100 / 3 * 1)
    empty = monitor.statistics(log.limit(0), ["timestamp", "id"]).first()
    assert empty["anomaly_rate_percent"] == 0.0 and empty["avg_inference_time_ms"] == 0.0


def moments(spark, rows):
    return spark.createDataFrame(rows, "feature string, mean double, std double, samples long")


def test_drift_modes_and_strict_threshold(spark):
    current = moments(spark, [("a", 1.2, 1.0, 5), ("b", -5.0, 1.0, 5), ("c", 1.0, 1.0, 5)])
    baseline = spark.createDataFrame([("a", 1.0 - 1e-10, 1.0), ("b", -1.0, 1.0), ("c", None, None)],
                                     "feature string, mean double, std double")
    table = {r["feature"]: r for r in monitor.drift_table(current, baseline).collect()}
    assert not table["b"]["mean_drifted"] and table["c"]["mean_drifted"] and not table["c"]["std_drifted"]
    absolute = {r["feature"]: r for r in monitor.drift_table(current, baseline, mode="abs").collect()}
    assert absolute["b"]["mean_drifted"]
    exact = moments(spark, [("a", 1.25, 1.0, 5)])
    base = spark.createDataFrame([("a", 1.0 - 1e-10, 1.0)], "feature string, mean double, std double")
    assert not monitor.drift_table(exact, base, threshold=0.2500000002).first()["mean_drifted"]
    record = monitor.check_drift(spark, current, baseline, features=["c", "b", "a"]).first()
    assert record["drift_detected"] and record["drift_features_mean_index"][-1] == 0


def test_drift_without_baseline_or_history(spark):
    log = smoke_log(spark)
    none = monitor.check_drift(spark, monitor.map_moments(log), None).first()
    assert not none["drift_detected"] and none["message"] == monitor.NO_BASELINE
    base = spark.createDataFrame([("x", 1.0, 1.0)], "feature string, mean double, std double")
    empty = monitor.check_drift(spark, monitor.map_moments(log.limit(0)), base).first()
    assert not empty["drift_detected"] and empty["message"] == monitor.NO_HISTORY


def test_log_round_trip_and_export(spark, tmp_path):
    log = smoke_log(spark).select(*plog.LOG_COLUMNS)
    for _ in range(2):
        plog.write_prediction_log(log, str(tmp_path / "log"))
    back = plog.read_prediction_log(spark, str(tmp_path / "log"))
    assert back.count() == 20
    assert back.select("timestamp", "prediction").distinct().count() == 10
    assert plog.export_logs(back, str(tmp_path / "json"), "json")
    lines = [json.loads(line) for f in (tmp_path / "json").glob("part-*") for line in f.read_text().splitlines()]
    assert len(lines) == 20 and set(lines[0]["features"]) == {"x"}
    assert not plog.export_logs(back.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    with pytest.raises(ValueError):
        plog.export_logs(back, str(tmp_path / "x"), "xml")


def test_streams_over_several_files_equal_the_batch(spark, tmp_path):
    log = smoke_log(spark)
    for part in range(3):
        log.where(F.pmod("id", F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stream_statistics(stream, "id", size=4).first()
    assert (got["total_predictions"], got["total_anomalies"], got["history_window_size"]) == (10, 4, 4)
    assert got["recent_anomaly_rate_percent"] == 50.0  # ids 6..9: 6 and 9


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    log = smoke_log(spark)
    early = log.withColumn("timestamp", F.col("timestamp") - F.expr("interval 10 days"))
    for part in (log, log.withColumn("timestamp", F.col("timestamp") + F.expr("interval 2 days")), early):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # file times decide the order of the micro-batches
    base = monitor.map_moments(log)
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    table, progress = drain_to_table(monitor.drift_by_bucket(stream, base, watermark="1 hour"), output_mode="update")
    assert late_rows(progress) >= 1
    assert table.select("bucket_start").distinct().count() == 2


def test_missing_group_keeps_its_curve(spark):
    df = spark.createDataFrame([(m, float(i), int(i > 4)) for m in ("a", None) for i in range(10)],
                               "model string, anomaly_score double, label int")
    assert {(r["model"], r["auc"]) for r in metrics.auc(df, ["model"]).collect()} == {("a", 1.0), (None, 1.0)}
    assert {(r["model"], r["count"]) for r in metrics.roc_points(df, ["model"]).groupBy("model").count().collect()} == {
        ("a", 11), (None, 11)}
    flagged = df.withColumn("prediction", F.col("label"))
    assert metrics.performance_summary(flagged, ["model"]).count() == 2


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_orders_agree_however_they_are_made(spark, monkeypatch, small):
    """Global positions, curves and areas over range partitions and in one sort, with ties and a missing model."""
    monkeypatch.setattr(ordering, "SMALL", small)
    draw = random.Random(12)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(2), float(draw.randrange(40))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "model string, label int, anomaly_score double").repartition(6)
    areas = {r.model: r.auc for r in metrics.auc(df, ["model"]).collect()}
    curve = metrics.score_curve(df, ["model"])
    points = {}
    for r in metrics.roc_points(df, ["model"], curve=curve).collect():
        points.setdefault(r.model, []).append((r.threshold, r.fpr, r.tpr))
    for model in ("a", "b", None):
        attacks = [s for m, label, s in rows if m == model and label == 1]
        benign = [s for m, label, s in rows if m == model and label == 0]
        wins = sum((x > y) + 0.5 * (x == y) for x in attacks for y in benign) / (len(attacks) * len(benign))
        assert areas[model] == pytest.approx(wins, abs=1e-12)
        assert sorted(points[model]) == sorted([(float("inf"), 0.0, 0.0)] + [
            (t, sum(y >= t for y in benign) / len(benign), sum(x >= t for x in attacks) / len(attacks))
            for t in set(attacks + benign)])
    numbered = spark.range(500).withColumn("x", F.col("id") * 7919 % 500).repartition(7)
    assert all(r.position == r.x for r in ordering.with_position(numbered, [F.col("x").asc()]).collect())
    names = spark.createDataFrame([("b",), ("é",), ("Z",), (None,), ("a",), ("a",)], "label string")
    monkeypatch.setattr(labels, "FEW", 0 if small == 0 else 10_000)
    assert {r.label: r.code for r in labels.label_mapping(names).collect()} == {"Z": 0, "a": 1, "b": 2, "é": 3}


def test_newest_rows_of_a_hot_model(spark):
    """A window beyond the planner's own limit, where one model has nearly all rows."""
    log = spark.range(60_000).select(F.when(F.col("id") % 100 == 0, "rare").otherwise("hot").alias("model_used"),
                                     (F.col("id") * 7919 % 60_000).alias("micros"), "id", F.lit(0).alias("prediction"))
    got = recent_rows(log, 5_000, salts=5).groupBy("model_used").agg(
        F.count("*").alias("n"), F.min("micros").alias("low"), F.count_distinct("id").alias("ids")).collect()
    by_model = {r.model_used: r for r in got}
    assert by_model["rare"].n == 600 and by_model["hot"].n == by_model["hot"].ids == 5_000
    hot = sorted((i * 7919 % 60_000 for i in range(60_000) if i % 100), reverse=True)
    assert by_model["hot"].low == hot[4_999]


def test_pipelines_with_their_steps(spark, tmp_path):
    """W3 and W4 from files, W6 and W7 with samples and filled features: quotas, result folders, days apart."""
    draw = random.Random(2)
    for day, attack in (("mon", None), ("tue", "DoS"), ("wed", "PortScan")):
        lines = [" a, b, k, Label"]
        for i in range(300):
            bad = attack and i % 3 == 0
            a = "inf" if i == 7 else "" if i == 11 else f"{draw.gauss(6 if bad else 0, 1):.4f}"
            lines.append(f"{a},{draw.gauss(0, 1):.4f},{day}{i},{attack if bad else 'BENIGN'}")
        (tmp_path / f"{day}.csv").write_text("\n".join(lines + lines[1:3]))
    models, tables = training.train_from_files(
        spark, str(tmp_path / "mon.csv"), [str(tmp_path / f"{d}.csv") for d in ("tue", "wed")],
        lambda features: {"svm": OneClassSVM(features, nu=0.05, max_iter=40)}, sample=250, keys=["k"], handle_nan="median",
        folder=str(tmp_path / "w3"))
    assert models["svm"].features == ["a", "b"] and models["svm"].n_rows <= 250
    assert 240 <= tables["scored"].count() <= 250 and {p.name for p in (tmp_path / "w3").iterdir()} == {"comparison", "gate", "per_attack"}
    assert metrics.classification_metrics(tables["scored"], ["model"]).first()["recall"] > 0.8

    catalog = {d: (f"{d}.csv", c) for d, c in (("mon", "BENIGN"), ("tue", "DoS"), ("wed", "PortScan"))}
    again = {"one": models["svm"], "two": models["svm"]}
    got = training.scenario_test_from_files(spark, str(tmp_path), again, "one", "two", catalog, max_rows=90, keys=["k"],
                                            folder=str(tmp_path / "w4"))
    rated = {(r.attack_category, r.model): r for r in got["metrics"].collect()}
    assert all(r.tp + r.tn + r.fp + r.fn == 90 for r in rated.values())
    attacks = {c: rated[c, "one"].tp + rated[c, "one"].fn for c in ("BENIGN", "DoS", "PortScan")}
    assert attacks["BENIGN"] == 0 and attacks["DoS"] == int(90 * 101 / 302) and (tmp_path / "w4" / "summary").exists()

    flows = read_days(spark, str(tmp_path), catalog).withColumnRenamed("Label", "label")
    audit = training.false_alarm_audit(flows, {"svm": models["svm"]}, sample=50, keys=["k"], fill=True)
    assert {r.day: r.samples_tested for r in audit["alarms"].collect()} == {"mon": 50, "tue": 50, "wed": 50}
    expected = spark.createDataFrame([("svm", 0.9, 0.9, 0.05)], "model string, f1 double, recall double, fpr double")
    sides = training.score_audit(flows, models["svm"], "svm", expected, per_side=80, keys=["k"], fill=True)
    row = sides["metrics"].first()
    assert row.tp + row.fn == 80 and row.tn + row.fp == 80
