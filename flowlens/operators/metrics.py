"""Evaluation of scored flows.

Input is the long scored frame: one row per (model, flow) with ``label`` (0/1), ``label_original``, ``prediction`` (0/1)
and ``anomaly_score`` (higher is worse). Every metric is one grouped aggregate whose partial sums are combined before the
shuffle, so a model, day or label that holds most rows costs no more than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import is_infinite, ratio
from flowlens.operators.ordering import join_groups, running_sums
from flowlens.operators.quantiles import grouped_percentiles, with_percentiles
from flowlens.spec import BENIGN

# Quality gates and percentiles.
F1_GATE = 0.85
SCENARIO_GATE, SCENARIOS_NEEDED = 0.80, 2
FALSE_ALARM_LIMIT = 0.10
SENSITIVITY_PERCENTILES = (90, 95, 99)
SEARCH_PERCENTILES = (90, 92, 95, 97, 99)
MATCH_TOLERANCE, LOW_RECALL, HIGH_FPR = 0.05, 0.10, 0.50


def confusion_columns(label: Column, prediction: Column) -> list[Column]:
    return [
        F.count_if((label == 1) & (prediction == 1)).alias("tp"),
        F.count_if((label == 0) & (prediction == 0)).alias("tn"),
        F.count_if((label == 0) & (prediction == 1)).alias("fp"),
        F.count_if((label == 1) & (prediction == 0)).alias("fn"),
    ]


def confusion_counts(df: DataFrame, by: list[str] | None = None, label: str = "label",
                     prediction: str = "prediction") -> DataFrame:
    """M1: tp, tn, fp, fn per group."""
    return df.groupBy(*(by or [])).agg(*confusion_columns(F.col(label), F.col(prediction)))


def add_rates(counts: DataFrame) -> DataFrame:
    """M2 from M1: rates are 0 where their denominator is 0."""
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    rated = counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "specificity": ratio(tn, tn + fp),
        "fpr": ratio(fp, fp + tn),
        "fnr": ratio(fn, fn + tp),
    })
    return rated.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _f1(precision: Column, recall: Column) -> Column:
    return ratio(2.0 * precision * recall, precision + recall)


def classification_metrics(df: DataFrame, by: list[str] | None = None, **columns) -> DataFrame:
    """M2."""
    return add_rates(confusion_counts(df, by, **columns))


def score_curve(df: DataFrame, by: list[str] | None = None, score: str = "anomaly_score",
                label: str = "label") -> DataFrame:
    """What ROC and AUC share: per group and distinct score the attacks ``p`` and benign rows ``q`` at it, those up to it
    (``p_to``, ``q_to``) and of the whole group (``p_all``, ``q_all``). The scores are ordered once."""
    by = by or []
    groups = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_score")).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("q"))
    return running_sums(groups, [F.col("_score").asc()], {"p_to": "p", "q_to": "q"}, by, {"p_all": "p", "q_all": "q"})


def roc_points(df: DataFrame, by: list[str] | None = None, score: str = "anomaly_score",
               label: str = "label", curve: DataFrame | None = None) -> DataFrame:
    """M3: (fpr, tpr, threshold) at each distinct score, highest first, and the origin at threshold infinity."""
    by = by or []
    curve = score_curve(df, by, score, label) if curve is None else curve
    tp, fp = (F.col(f"{c}_all") - F.col(f"{c}_to") + F.col(c) for c in ("p", "q"))
    points = curve.select(*by, ratio(fp, F.col("q_all")).alias("fpr"), ratio(tp, F.col("p_all")).alias("tpr"),
                          F.col("_score").alias("threshold"))
    origin = curve.groupBy(*by).agg(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
                                    F.lit(float("inf")).alias("threshold"))
    return points.unionByName(origin)


def auc(df: DataFrame, by: list[str] | None = None, score: str = "anomaly_score", label: str = "label",
        curve: DataFrame | None = None) -> DataFrame:
    """M4: the share of (attack, benign) pairs ranked rightly, ties half; no pair is ever formed."""
    by = by or []
    curve = score_curve(df, by, score, label) if curve is None else curve
    won = F.col("p") * ((F.col("q_to") - F.col("q")) + 0.5 * F.col("q"))
    return curve.groupBy(*by).agg(
        F.sum(won).alias("_won"), F.sum("p").cast("double").alias("_P"), F.sum("q").cast("double").alias("_N")
    ).select(*by, ratio(F.col("_won"), F.col("_P") * F.col("_N")).alias("auc"))


def confusion_table(df: DataFrame, by: list[str] | None = None, normalise: bool = False, label: str = "label",
                    prediction: str = "prediction") -> DataFrame:
    """M5: one row per (true, predicted) pair, optionally with the share of the true class."""
    by = by or []
    counts = df.groupBy(*by, label, prediction).agg(F.count("*").alias("count"))
    if not normalise:
        return counts
    per_class = Window.partitionBy(*by, label)
    return counts.withColumn("share", F.col("count") / F.sum("count").over(per_class))


def fixed4(column: Column) -> Column:
    return F.format_string("%.4f", column.cast("double"))


def performance_summary(df: DataFrame, by: list[str] | None = None, curve: DataFrame | None = None) -> DataFrame:
    """M6: M2 and M4 as text with four decimals."""
    by = by or ["model"]
    rated = join_groups(classification_metrics(df, by), auc(df, by, curve=curve), by)
    named = {"Accuracy": "accuracy", "Precision": "precision", "Recall": "recall", "F1_Score": "f1", "AUC": "auc",
             "Specificity": "specificity", "FPR": "fpr", "FNR": "fnr"}
    return rated.select(
        *by, *[fixed4(F.col(c)).alias(n) for n, c in named.items()],
        F.col("tp").alias("True_Positives"), F.col("tn").alias("True_Negatives"),
        F.col("fp").alias("False_Positives"), F.col("fn").alias("False_Negatives"),
    )


def classification_report(df: DataFrame, by: list[str] | None = None, names: tuple[str, str] = (BENIGN, "ATTACK"),
                          ) -> DataFrame:
    """M7: per class precision, recall, F1 and support; accuracy; macro and weighted averages."""
    by = by or []
    counts = confusion_counts(df, by)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))

    def entry(name, hit, predicted, support):
        precision, recall = ratio(hit, predicted), ratio(hit, support)
        return F.struct(F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
                        _f1(precision, recall).alias("f1"), support.cast("double").alias("support"))

    classes = counts.select(*by, "tp", "tn", "fp", "fn", entry(names[0], tn, tn + fn, tn + fp).alias("b"),
                            entry(names[1], tp, tp + fp, tp + fn).alias("a"))
    total = (tp + tn + fp + fn).cast("double")
    accuracy = ratio(tp + tn, total)

    def average(name, weight_b, weight_a):
        mean = lambda c: F.col(f"b.{c}") * weight_b + F.col(f"a.{c}") * weight_a
        return F.struct(F.lit(name).alias("class"), mean("precision").alias("precision"),
                        mean("recall").alias("recall"), mean("f1").alias("f1"), total.alias("support"))

    rows = F.array(
        F.col("b"), F.col("a"),
        F.struct(F.lit("accuracy").alias("class"), accuracy.alias("precision"), accuracy.alias("recall"),
                 accuracy.alias("f1"), total.alias("support")),
        average("macro avg", F.lit(0.5), F.lit(0.5)),
        average("weighted avg", ratio(F.col("b.support"), total), ratio(F.col("a.support"), total)),
    )
    return classes.select(*by, F.inline(rows))


def evaluate_model(scored: DataFrame, importances: DataFrame | None = None, top: int = 20) -> dict[str, DataFrame]:
    """M8: every table of one evaluation, from one (cached) scored frame; its scores are ordered once."""
    curve = score_curve(scored, ["model"])
    tables = {
        "metrics": classification_metrics(scored, ["model"]),
        "summary": performance_summary(scored, ["model"], curve),
        "roc": roc_points(scored, ["model"], curve=curve),
        "confusion": confusion_table(scored, ["model"], normalise=True),
        "report": classification_report(scored, ["model"]),
    }
    if importances is not None:
        tables["importance"] = importance_table(importances, top)
    return tables


def importance_table(importances: DataFrame, top: int = 20) -> DataFrame:
    """The largest importances, ties by name."""
    return importances.orderBy(F.col("importance").desc(), "feature").limit(top)


def per_attack(df: DataFrame, by: list[str] | None = None, benign: str = BENIGN) -> DataFrame:
    """M9: one row per attack label, most frequent first. Inside a class every row is positive, so precision is 1 or 0."""
    by = by or []
    detected, samples = F.col("detected"), F.col("samples")
    recall = ratio(detected, samples)
    precision = F.when(detected > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return (
        df.where(~F.col("label_original").eqNullSafe(benign))
        .groupBy(*by, F.col("label_original").alias("attack_type"))
        .agg(F.count("*").alias("samples"), F.count_if(F.col("prediction") == 1).alias("detected"))
        .select(*by, "attack_type", "samples", "detected", (samples - detected).alias("missed"),
                recall.alias("detection_rate"), precision.alias("precision"), recall.alias("recall"),
                _f1(precision, recall).alias("f1"))
        .orderBy(F.col("samples").desc(), "attack_type", *by)
    )


def per_class(df: DataFrame, by: list[str] | None = None, benign: str = BENIGN) -> DataFrame:
    """Share of rows judged rightly per label; a benign row is right when it is not flagged."""
    by = by or ["model"]
    expected = F.when(F.col("label_original") == benign, 0).otherwise(1)
    return df.groupBy(*by, F.col("label_original").alias("attack_type")).agg(
        F.count("*").alias("count"),
        (F.count_if(F.col("prediction") == expected) / F.count("*")).alias("detection_rate"))


def false_alarms(df: DataFrame, group: str = "day") -> DataFrame:
    """Benign rows flagged, per day and model."""
    return df.where(F.col("label") == 0).groupBy(group, "model").agg(
        F.count("*").alias("samples_tested"), F.count_if(F.col("prediction") == 1).alias("fp_count"),
    ).withColumn("fp_rate", ratio(F.col("fp_count"), F.col("samples_tested")))


def false_alarm_verdict(alarms: DataFrame, limit: float = FALSE_ALARM_LIMIT) -> DataFrame:
    """Mean of the daily rates per model, and whether it stays below the limit."""
    return alarms.groupBy("model").agg(F.avg("fp_rate").alias("mean_fp_rate")).withColumn(
        "passed", F.col("mean_fp_rate") < limit)


def multi_day(df: DataFrame) -> DataFrame:
    """M2 per (day, attack category, model)."""
    return classification_metrics(df, ["day", "attack_type", "model"])


def pivot_mean(df: DataFrame, rows: str, columns: str, value: str, names: list[str]) -> DataFrame:
    """Mean of ``value`` with one column per listed name; the list spares a pass over the data."""
    return df.groupBy(rows).pivot(columns, names).agg(F.avg(value))


def compare_models(df: DataFrame) -> DataFrame:
    """One row per model with the ranks of its F1 (ties by name), best and worst marked."""
    rated = classification_metrics(df, ["model"])
    down = F.row_number().over(Window.orderBy(F.col("f1").desc(), "model"))
    up = F.row_number().over(Window.orderBy(F.col("f1").asc(), "model"))
    return rated.withColumns({"is_best": down == 1, "is_worst": up == 1})


def quality_gate(rated: DataFrame, gate: float = F1_GATE) -> DataFrame:
    """PASS or FAIL by F1, with the distance to the gate."""
    return rated.withColumns({
        "gate": F.when(F.col("f1") >= gate, "PASS").otherwise("FAIL"),
        "gap": F.lit(gate) - F.col("f1"),
    })


def scenario_gate(rated: DataFrame, gate: float = SCENARIO_GATE, needed: int = SCENARIOS_NEEDED) -> DataFrame:
    """Per model, scenarios that reach the gate and the overall verdict."""
    return rated.groupBy("model").agg(
        F.count_if(F.col("f1") >= gate).alias("passed"), F.count("*").alias("scenarios"), F.avg("f1").alias("avg_f1"),
    ).withColumn("gate", F.when(F.col("passed") >= needed, "PASS").otherwise("FAIL"))


def scenario_summary(rated: DataFrame, first: str, second: str, scenario: str = "scenario") -> DataFrame:
    """F1 of two models side by side per scenario; an equal F1 goes to the second."""
    wide = rated.groupBy(scenario).pivot("model", [first, second]).agg(F.max("f1"))
    return wide.select(scenario, F.col(first).alias("f1_first"), F.col(second).alias("f1_second"),
                       F.when(F.col(first) > F.col(second), first).otherwise(second).alias("winner"))


def relative_improvement(new: DataFrame, old: DataFrame, key: str = "model", value: str = "f1") -> DataFrame:
    """(new - old) / old * 100 per model."""
    before = old.select(key, F.col(value).alias("old_value"))
    return new.select(key, F.col(value).alias("new_value")).join(before, key).withColumn(
        "improvement_percent", ratio(F.col("new_value") - F.col("old_value"), F.col("old_value")) * 100.0)


def threshold_trials(df: DataFrame, percentiles: tuple[int, ...], benign_only: bool, by: str = "model",
                     score: str = "anomaly_score", label: str = "label") -> DataFrame:
    """Metrics at thresholds taken from percentiles of the scores (of benign rows, or of all rows).

    Thresholds are exact; one more pass counts each model's rows by label and by how many of its thresholds they exceed,
    and the suffixes of those counts are the hits at every threshold. A model without a score has null thresholds.
    """
    ordered = sorted(set(percentiles))
    chosen = df.where(F.col(label) == 0) if benign_only else df
    thresholds = grouped_percentiles(chosen, [by], score, [p / 100 for p in ordered])
    rows = with_percentiles(df.select(by, label, score), [by], thresholds, "_t")
    exceeded = F.size(F.filter("_t", lambda t: F.col(score) > t))
    slots = (rows.select(by, label, "_t", F.when(F.col("_t").isNotNull() & F.col(score).isNotNull(), exceeded).alias("_slot"))
             .groupBy(by, label, "_t", "_slot").agg(F.count("*").alias("_n")))
    trials = F.array(*[F.struct(F.lit(j).alias("_j"), F.lit(p).alias("percentile"), F.get("_t", F.lit(j)).alias("threshold"))
                       for j, p in enumerate(ordered)])
    hit = (F.col("_slot") > F.col("_j")).cast("int")

    def total(wanted: int, flagged: int, name: str) -> Column:
        counted = F.when((F.col(label) == wanted) & (hit == flagged), F.col("_n"))
        return F.coalesce(F.sum(counted), F.lit(0)).cast("long").alias(name)

    counts = slots.select(by, label, "_slot", "_n", F.inline(trials)).groupBy(by, "percentile", "threshold").agg(
        total(1, 1, "tp"), total(0, 0, "tn"), total(0, 1, "fp"), total(1, 0, "fn"))
    return add_rates(counts)


def best_threshold(trials: DataFrame, by: str = "model") -> DataFrame:
    """The trial of the best F1 per model, the smallest percentile first among equals."""
    row = F.struct("percentile", "threshold", "precision", "recall", "f1")
    order = F.struct(F.col("f1"), -F.col("percentile"))
    return trials.groupBy(by).agg(F.max_by(row, order).alias("row")).select(by, "row.*")


def diagnose(actual: DataFrame, expected: DataFrame, key: str = "model") -> DataFrame:
    """Differences to expected values and a verdict. ``expected``: key, f1, recall, fpr."""
    want = expected.select(key, *[F.col(c).alias(f"expected_{c}") for c in ("f1", "recall", "fpr")])
    joined = actual.select(key, "f1", "recall", "fpr").join(want, key)
    verdict = (
        F.when(F.abs(F.col("f1") - F.col("expected_f1")) < MATCH_TOLERANCE, "matches expected")
        .when(F.col("recall") < LOW_RECALL, "recall extremely low")
        .when(F.col("fpr") > HIGH_FPR, "false positive rate extremely high")
        .otherwise("differs")
    )
    return joined.withColumns({
        "diff_f1": F.col("f1") - F.col("expected_f1"),
        "diff_recall": F.col("recall") - F.col("expected_recall"),
        "diff_fpr": F.col("fpr") - F.col("expected_fpr"),
        "diagnosis": verdict,
    })


def hardest_attacks(rates: DataFrame, n: int = 3, benign: str = BENIGN) -> DataFrame:
    """Attack labels with the smallest mean detection rate over models."""
    return (
        rates.where(F.col("attack_type") != benign)
        .groupBy("attack_type").agg(F.avg("detection_rate").alias("mean_detection_rate"))
        .orderBy("mean_detection_rate", "attack_type").limit(n)
    )


def grid_analysis(grid: DataFrame, parameter: str = "kernel", second: str = "nu", order: str = "gamma",
                  n: int = 5) -> dict[str, DataFrame]:
    """Best F1 by one parameter, by both, the first row of each value, and the top rows."""
    first = F.struct(*grid.columns)
    return {
        "best_by_parameter": grid.groupBy(parameter).agg(F.max("f1").alias("best_f1")),
        "best_by_both": grid.groupBy(parameter, second).agg(F.max("f1").alias("best_f1")),
        "first_by_second": grid.groupBy(second).agg(
            F.min_by(first, F.struct(parameter, order)).alias("row")).select("row.*"),
        "top": grid.orderBy(F.col("f1").desc(), second, parameter, order).limit(n),
    }


def batch_summary(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals of a scored batch; rows that could not be scored (label text ``ERROR``) are counted apart."""
    total = F.count("*")
    return df.groupBy(*(by or [])).agg(
        total.alias("total"),
        F.count_if(F.col("prediction_label") == "ATTACK").alias("attacks"),
        F.count_if(F.col("prediction_label") == "BENIGN").alias("benign"),
        F.count_if(F.col("prediction_label") == "ERROR").alias("errors"),
        ratio(F.count_if(F.col("prediction_label") == "ATTACK") * 100.0, total).alias("anomaly_rate_percent"),
    )


def score_statistics(df: DataFrame, by: str = "model", score: str = "anomaly_score") -> DataFrame:
    """Extremes, mean, exact median, NaN and infinite counts, share flagged."""
    x = F.when(~F.isnan(score), F.col(score))
    statistics = df.groupBy(by).agg(
        F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.count_if(F.isnan(score) | F.col(score).isNull()).alias("nan_count"),
        F.count_if(is_infinite(F.col(score))).alias("inf_count"),
        (F.count_if(F.col("prediction") == 1) / F.count("*")).alias("predicted_attack_share"),
    )
    medians = with_percentiles(statistics, [by], grouped_percentiles(df, [by], score, [0.5]), "_median")
    return medians.withColumn("median", F.get("_median", F.lit(0))).drop("_median")
