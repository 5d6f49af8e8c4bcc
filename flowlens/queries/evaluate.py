"""Profile and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.numeric import sigmoid  # noqa: F401
from flowlens.operators import labels, metrics, profile
from flowlens.operators.clean import FlowCleaner
from flowlens.queries.prepare import CLEANED, DUPLICATED
from flowlens.queries.registry import (
    FLOWS, KEYS, LONG, RATES, SIGNAL, query, r, rated_sql, ratio_sql, rounded, rounded_sql,
)
from flowlens.session import keep
from flowlens.sources import views
from flowlens.sources.views import FEATURES, FLOW_KEYS, flows, flows_signal, scored, with_duplicates

PROFILED = ["flow_duration", "total_bytes", "bytes_per_s", "iat_mean", "const_zero"]


# ---- profile -------------------------------------------------------------------------------------------------------

SHAPE = ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"]


@query("e1_schema_report", " union all ".join(
    f"select {i}::integer as position, '{c}' as \"column\", '{t}' as type, count(*) as rows, count({c}) as non_null "
    f"from lineitem" for i, (c, t) in enumerate(zip(SHAPE, ["bigint", "double", "double", "string", "timestamp"]))))
def e1(spark, sf_dir):
    df = views.table(spark, sf_dir, "lineitem").select(*SHAPE)
    return profile.schema_report(df).withColumn("type", F.regexp_replace("type", "timestamp_ntz", "timestamp"))


def _defects(condition: str, count: str, percent: str) -> str:
    rows = " union all ".join(
        f"select '{f}' as feature, count(*) filter ({condition.format(f)}) as {count}, "
        f"{r(f'count(*) filter ({condition.format(f)}) * 100.0 / count(*)', 6, percent)} from flows" for f in PROFILED)
    return f"with {FLOWS} select * from ({rows}) where {count} > 0"


@query("e2_missing_profile", _defects("{0} is null", "missing_count", "missing_percent"))
def e2(spark, sf_dir):
    return rounded(profile.missing_profile(flows(spark, sf_dir), PROFILED))


@query("e3_infinite_profile", _defects("{0} = 'Infinity'::double", "infinite_count", "infinite_percent"))
def e3(spark, sf_dir):
    return rounded(profile.infinite_profile(flows(spark, sf_dir), PROFILED))


@query("e4_duplicates", f"""with {DUPLICATED}, groups as (select count(*) as n from doubled group by all_cols)
  select sum(n - 1)::bigint as duplicate_rows, sum(n)::bigint as rows,
  {r("sum(n - 1) * 100.0 / sum(n)", 6, "duplicate_percent")} from groups""".replace(
    "all_cols", f"{KEYS}, flow_duration, total_bytes, bytes_per_s, iat_mean, const_zero, label, day"))
def e4(spark, sf_dir):
    return rounded(profile.duplicate_profile(with_duplicates(flows(spark, sf_dir))))


@query("e5_label_distribution", f"""with {FLOWS} select label, count(*) as count,
  {r("count(*) * 1.0 / sum(count(*)) over ()", 6, "share")}, (select count(distinct label) from flows) as distinct_labels
  from flows group by label""")
def e5(spark, sf_dir):
    df = flows(spark, sf_dir)
    distinct = df.agg(F.count_distinct("label")).scalar()
    return rounded(labels.label_distribution(df).withColumn("distinct_labels", distinct))


def _describe_sql(features: list[str]) -> str:
    return f"with {FLOWS} " + " union all ".join(
        f"select '{f}' as feature, count({f}) as count, {r(f'avg({f})', 4, 'mean')}, "
        f"{r(f'stddev_samp({f})', 4, 'std')}, {r(f'min({f})', 4, 'min')}, {r(f'quantile_cont({f}, 0.25)', 4, 'p25')}, "
        f"{r(f'quantile_cont({f}, 0.5)', 4, 'p50')}, {r(f'quantile_cont({f}, 0.75)', 4, 'p75')}, "
        f"{r(f'max({f})', 4, 'max')} from flows" for f in features)


NO_INF = ["flow_duration", "total_bytes", "iat_mean", "const_zero"]


@query("e6_describe", _describe_sql(NO_INF))
def e6(spark, sf_dir):
    return rounded(profile.describe(flows(spark, sf_dir), NO_INF), 4)


@query("e7_constant_features", f"with {FLOWS} select feature, low as value from (" + " union all ".join(
    f"select '{f}' as feature, min({f}) as low, max({f}) as high from flows" for f in PROFILED) + ") where low = high")
def e7(spark, sf_dir):
    return profile.constant_features(flows(spark, sf_dir), PROFILED)


def _histogram_sql(features: list[str]) -> str:
    parts = []
    for f in features:
        parts.append(f"""select '{f}' as feature, bin, {r("lo + bin * width", 4, "bin_start")}, count(*) as count from (
          select lo, width, cast(least(floor((x - lo) / width), 49) as integer) as bin from (
            select {f} as x, min({f}) over () as lo, (max({f}) over () - min({f}) over ()) / 50 as width
            from flows where {f} < 'Infinity'::double)) group by bin, lo, width""")
    return f"with {FLOWS} " + " union all ".join(parts)


@query("e8_histogram", _histogram_sql(["flow_duration", "total_bytes", "bytes_per_s", "iat_mean"]))
def e8(spark, sf_dir):
    return rounded(profile.histogram(flows(spark, sf_dir),
                                     ["flow_duration", "total_bytes", "bytes_per_s", "iat_mean"]), 4)


CORRELATED = ["flow_duration", "total_bytes", "bytes_per_s", "iat_mean", "packets"]
CORRELATION = FLOWS + """, complete as (select *, flow_duration * 2 + iat_mean as packets from flows
  where iat_mean is not null and bytes_per_s < 'Infinity'::double), matrix as (""" + " union all ".join(
    f"select '{a}' as feature_a, '{b}' as feature_b, corr({a}, {b}) as r from complete"
    for i, a in enumerate(CORRELATED) for b in CORRELATED[i + 1:]) + ")"


def _correlated(spark, sf_dir):
    df = flows(spark, sf_dir)
    return df.withColumn("packets", F.col("flow_duration") * 2 + F.col("iat_mean"))


@query("e9_correlation", f"with {CORRELATION} select feature_a, feature_b, {r('r', 6, 'r')} from matrix")
def e9(spark, sf_dir):
    return rounded(profile.correlation(_correlated(spark, sf_dir), CORRELATED))


@query("e10_high_correlation", f"""with {CORRELATION} select feature_a, feature_b, {r('r', 6, 'r')} from matrix
  where abs(r) > 0.9 order by abs(r) desc limit 10""")
def e10(spark, sf_dir):
    return rounded(profile.high_correlation_pairs(profile.correlation(_correlated(spark, sf_dir), CORRELATED)))


def _count_features(condition: str) -> str:
    parts = " union all ".join(f"select {condition.format(c)} as hit from wide" for c in CORRELATED)
    return f"(select count(*) from ({parts}) where hit)"


@query("e11_quality_summary", f"""with {CORRELATION}, wide as (select *, flow_duration * 2 + iat_mean as packets from flows)
  select count(*) as total_rows, 5::integer as total_features, 5::integer as numeric_features,
  {_count_features("count(*) filter ({0} is null) > 0")} as missing_value_cols,
  {_count_features("count(*) filter ({0} = 'Infinity'::double) > 0")} as infinite_value_cols,
  (count(*) - (select count(*) from (select distinct * from wide)))::bigint as duplicate_rows,
  {r("(count(*) - (select count(*) from (select distinct * from wide))) * 100.0 / count(*)", 6, "duplicate_percent")},
  {_count_features("min({0}) = max({0})")} as constant_features,
  (select count(*) from matrix where abs(r) > 0.9) as high_corr_pairs, count(distinct label) as unique_labels
  from wide""")
def e11(spark, sf_dir):
    return rounded(profile.quality_summary(_correlated(spark, sf_dir), CORRELATED))


@query("e12_pipeline_statistics", f"""with {CLEANED} select (select count(*) from doubled) as initial_rows,
  11::integer as initial_columns, count(*) as final_rows, 10::integer as final_columns,
  (select count(*) from doubled) - count(*) as rows_removed, count(*) filter (label = 'BENIGN') as benign,
  count(*) filter (label <> 'BENIGN') as attacks, {r("count(*) filter (label <> 'BENIGN') / count(*)", 6, "attack_ratio")}
  from cleaned""")
def e12(spark, sf_dir):
    df = with_duplicates(flows(spark, sf_dir))
    cleaned = FlowCleaner(FEATURES, keep=FLOW_KEYS).fit(df).transform(df)
    return rounded(profile.pipeline_statistics(df, cleaned))


@query("e12_attack_counts", f"with {FLOWS} select label, count(*) as count from flows where label <> 'BENIGN' group by label")
def e12_attacks(spark, sf_dir):
    return profile.attack_counts(flows(spark, sf_dir))


@query("e13_score_statistics", f"""with {LONG} select model, {r("min(anomaly_score)", 4, "min")},
  {r("max(anomaly_score)", 4, "max")}, {r("avg(anomaly_score)", 4, "mean")}, {r("median(anomaly_score)", 4, "median")},
  0::bigint as nan_count, 0::bigint as inf_count, {r("avg(prediction)", 4, "predicted_attack_share")}
  from scored group by model""")
def e13(spark, sf_dir):
    return rounded(metrics.score_statistics(keep(scored(spark, sf_dir))), 4)


# ---- evaluation ----------------------------------------------------------------------------------------------------

@query("m1_confusion_counts", f"with {LONG}, {rated_sql('scored', 'model')} select model, tp, tn, fp, fn from rated")
def m1(spark, sf_dir):
    return metrics.confusion_counts(scored(spark, sf_dir), ["model"])


@query("m2_classification_metrics", f"""with {LONG}, {rated_sql('scored', 'model')}
  select model, tp, tn, fp, fn, {rounded_sql(RATES)} from rated""")
def m2(spark, sf_dir):
    return rounded(metrics.classification_metrics(scored(spark, sf_dir), ["model"]))


SCORE_GROUPS = """score_groups as (select model, anomaly_score as score, count(*) filter (label = 1) as p,
    count(*) filter (label = 0) as q from scored group by model, anomaly_score)"""
AUC = SCORE_GROUPS + """, score_ranks as (select *, coalesce(sum(q) over (partition by model order by score
    rows between unbounded preceding and 1 preceding), 0)::double as before from score_groups),
  auc as (select model, sum(p * (before + 0.5 * q)) / (sum(p)::double * sum(q)::double) as auc from score_ranks
    group by model)"""


@query("m3_roc_points", f"""with {LONG}, {SCORE_GROUPS}, sums as (select model, score,
    sum(p) over (w) as tp, sum(q) over (w) as fp, sum(p) over (partition by model) as all_p,
    sum(q) over (partition by model) as all_q from score_groups
    window w as (partition by model order by score desc rows between unbounded preceding and current row))
  select model, {r("fp::double / all_q", 6, "fpr")}, {r("tp::double / all_p", 6, "tpr")},
    {r("score", 8, "threshold")} from sums
  union all select distinct model, 0.0::double, 0.0::double, -1.0::double from score_groups""".replace("over (w)", "over w"))
def m3(spark, sf_dir):
    points = metrics.roc_points(scored(spark, sf_dir), ["model"])
    return rounded(points.withColumn("threshold", F.when(F.col("threshold") == float("inf"), -1.0).otherwise(
        F.col("threshold"))), 6, threshold=8)


@query("m4_auc", f"with {LONG}, {AUC} select model, {r('auc', 6, 'auc')} from auc")
def m4(spark, sf_dir):
    return rounded(metrics.auc(scored(spark, sf_dir), ["model"]))


@query("m4_auc_events", f"""with scored as (select 'value' as model, value as anomaly_score,
  case when event_type = 'error' then 1 else 0 end as label from events), {AUC} select {r('auc', 6, 'auc')} from auc""")
def m4_events(spark, sf_dir):
    log = views.prediction_log(spark, sf_dir).select("anomaly_score", F.col("prediction").alias("label"))
    return rounded(metrics.auc(log))


@query("m5_confusion_matrix", f"""with {LONG}, counts as (select model, label, prediction, count(*) as count
  from scored group by all) select model, label, prediction, count,
  {r("count / sum(count) over (partition by model, label)", 6, "share")} from counts""")
def m5(spark, sf_dir):
    return rounded(metrics.confusion_table(scored(spark, sf_dir), ["model"], normalise=True))


def _text(column: str, name: str) -> str:
    return f"printf('%.4f', {column}) as {name}"


@query("m6_performance_summary", f"""with {LONG}, {AUC}, {rated_sql('scored', 'model')}
  select rated.model, {_text('accuracy', 'Accuracy')}, {_text('precision', 'Precision')}, {_text('recall', 'Recall')},
  {_text('f1', 'F1_Score')}, {_text('auc', 'AUC')}, {_text('specificity', 'Specificity')}, {_text('fpr', 'FPR')},
  {_text('fnr', 'FNR')}, tp as True_Positives, tn as True_Negatives, fp as False_Positives, fn as False_Negatives
  from rated join auc on rated.model = auc.model""")
def m6(spark, sf_dir):
    return metrics.performance_summary(scored(spark, sf_dir))


@query("m7_classification_report", f"""with {LONG}, {rated_sql('scored', 'model')}, parts as (
  select model, {ratio_sql('tn', 'tn + fn')} as pb, {ratio_sql('tn', 'tn + fp')} as rb, (tn + fp)::double as sb,
    precision as pa, recall as ra, f1 as fa, (tp + fn)::double as sa, accuracy as acc from rated),
  full_parts as (select *, {ratio_sql('2.0 * pb * rb', 'pb + rb')} as fb, sa + sb as s from parts),
  report as (
  select model, 'BENIGN' as class, pb as precision, rb as recall, fb as f1, sb as support from full_parts
  union all select model, 'ATTACK', pa, ra, fa, sa from full_parts
  union all select model, 'accuracy', acc, acc, acc, s from full_parts
  union all select model, 'macro avg', (pa + pb) / 2, (ra + rb) / 2, (fa + fb) / 2, s from full_parts
  union all select model, 'weighted avg', (pa * sa + pb * sb) / s, (ra * sa + rb * sb) / s, (fa * sa + fb * sb) / s, s
    from full_parts)
  select model, class, {rounded_sql(['precision', 'recall', 'f1', 'support'])} from report""")
def m7(spark, sf_dir):
    return rounded(metrics.classification_report(scored(spark, sf_dir), ["model"]))


@query("m8_evaluate_model", f"""with {LONG}, {AUC}, {rated_sql('scored', 'model')}
  select rated.model, {rounded_sql(['accuracy', 'f1'])}, {_text('f1', 'F1_Score')} from rated""")
def m8(spark, sf_dir):
    tables = metrics.evaluate_model(keep(scored(spark, sf_dir)))
    return rounded(tables["metrics"].select("model", "accuracy", "f1").join(
        tables["summary"].select("model", "F1_Score"), "model"))


@query("m9_per_attack", f"""with {LONG}, counts as (select model, label_original as attack_type, count(*) as samples,
    count(*) filter (prediction = 1) as detected from scored where label_original <> 'BENIGN' group by all),
  rates as (select *, detected::double / samples as recall, (case when detected > 0 then 1.0 else 0.0 end)::double as precision from counts)
  select model, attack_type, samples, detected, samples - detected as missed, {r("recall", 6, "detection_rate")},
    precision, {r("recall", 6, "recall")},
    {r(ratio_sql("2.0 * precision * recall", "precision + recall"), 6, "f1")} from rates""")
def m9(spark, sf_dir):
    return rounded(metrics.per_attack(scored(spark, sf_dir), ["model"]))


PER_CLASS = """per_class as (select model, label_original as attack_type, count(*) as count,
  count(*) filter (prediction = case when label_original = 'BENIGN' then 0 else 1 end)::double / count(*)
    as detection_rate from scored group by all)"""


@query("m10_per_class", f"""with {LONG}, {PER_CLASS} select model, attack_type, count,
  {r('detection_rate', 6, 'detection_rate')} from per_class""")
def m10(spark, sf_dir):
    return rounded(metrics.per_class(scored(spark, sf_dir)))


ALARMS = """alarms as (select day, model, count(*) as samples_tested, count(*) filter (prediction = 1) as fp_count,
  count(*) filter (prediction = 1)::double / count(*) as fp_rate from scored where label = 0 group by all)"""


@query("m11_false_alarms", f"""with {LONG}, {ALARMS} select day, model, samples_tested, fp_count,
  {r('fp_rate', 6, 'fp_rate')} from alarms""")
def m11(spark, sf_dir):
    return rounded(metrics.false_alarms(scored(spark, sf_dir)))


@query("m11_false_alarm_verdict", f"""with {LONG}, {ALARMS} select model, {r('avg(fp_rate)', 6, 'mean_fp_rate')},
  avg(fp_rate) < 0.1 as passed from alarms group by model""")
def m11_verdict(spark, sf_dir):
    return rounded(metrics.false_alarm_verdict(metrics.false_alarms(scored(spark, sf_dir))))


CATEGORISED = """categorised as (select *, case when day in ('Saturday', 'Sunday') then 'PortScan' else 'DoS/DDoS' end
  as attack_type from scored)"""


def _categorised(spark, sf_dir):
    return scored(spark, sf_dir).withColumn(
        "attack_type", F.when(F.col("day").isin("Saturday", "Sunday"), "PortScan").otherwise("DoS/DDoS"))


@query("m12_multi_day", f"""with {LONG}, {CATEGORISED}, {rated_sql('categorised', 'day, attack_type, model')}
  select day, attack_type, model, tp, tn, fp, fn, {rounded_sql(RATES)} from rated""")
def m12(spark, sf_dir):
    return rounded(metrics.multi_day(_categorised(spark, sf_dir)))


def _pivot_sql(group: str, value: str, source: str) -> str:
    columns = ", ".join(r(f"avg({value}) filter (model = '{m}')", 6, m) for m in views.SCORERS)
    return f"select {group}, {columns} from {source} group by {group}"


@query("m12_pivot", f"""with {LONG}, {CATEGORISED}, {rated_sql('categorised', 'day, attack_type, model')}
  {_pivot_sql('attack_type', 'f1', 'rated')}""")
def m12_pivot(spark, sf_dir):
    return rounded(metrics.pivot_mean(metrics.multi_day(_categorised(spark, sf_dir)), "attack_type", "model", "f1",
                                      list(views.SCORERS)))


@query("m13_pivot_detection", f"with {LONG}, {PER_CLASS} {_pivot_sql('attack_type', 'detection_rate', 'per_class')}")
def m13(spark, sf_dir):
    return rounded(metrics.pivot_mean(metrics.per_class(scored(spark, sf_dir)), "attack_type", "model",
                                      "detection_rate", list(views.SCORERS)))


@query("m14_compare_models", f"""with {LONG}, {rated_sql('scored', 'model')}
  select model, {rounded_sql(['precision', 'recall', 'f1', 'fpr'])},
  row_number() over (order by f1 desc, model) = 1 as is_best, row_number() over (order by f1, model) = 1 as is_worst
  from rated""")
def m14(spark, sf_dir):
    return rounded(metrics.compare_models(scored(spark, sf_dir)).select(
        "model", "precision", "recall", "f1", "fpr", "is_best", "is_worst"))


@query("m15_quality_gate", f"""with {LONG}, {rated_sql('scored', 'model')}
  select model, case when f1 >= 0.85 then 'PASS' else 'FAIL' end as gate, {r("0.85::double - f1", 6, "gap")} from rated""")
def m15(spark, sf_dir):
    return rounded(metrics.quality_gate(metrics.classification_metrics(scored(spark, sf_dir), ["model"])).select(
        "model", "gate", "gap"))


BY_SCENARIO = f"""attacks_only as (select *, case label_original when 'BENIGN' then null else label_original end as kind
    from scored), scenarios as (
    select 'DoS Hulk' as scenario, * from scored where label_original in ('BENIGN', 'DoS Hulk')
    union all select 'PortScan', * from scored where label_original in ('BENIGN', 'PortScan'))"""


def _scenarios(spark, sf_dir):
    """Each attack family against all benign flows."""
    df = scored(spark, sf_dir)
    attacks = list(views.SIGNAL)
    names = F.when(F.col("label") == 0, F.array(*[F.lit(a) for a in attacks])).otherwise(
        F.array(F.col("label_original")))
    return metrics.classification_metrics(df.withColumn("scenario", F.explode(names)), ["scenario", "model"])


@query("m15_scenario_gate", f"""with {LONG}, {BY_SCENARIO}, {rated_sql('scenarios', 'scenario, model')}
  select model, count(*) filter (f1 >= 0.3) as passed, count(*) as scenarios, {r('avg(f1)', 6, 'avg_f1')},
  case when count(*) filter (f1 >= 0.3) >= 1 then 'PASS' else 'FAIL' end as gate from rated group by model""")
def m15_scenario(spark, sf_dir):
    return rounded(metrics.scenario_gate(_scenarios(spark, sf_dir), gate=0.3, needed=1))


@query("m16_scenario_summary", f"""with {LONG}, {BY_SCENARIO}, {rated_sql('scenarios', 'scenario, model')},
  wide as (select scenario, max(f1) filter (model = 'bytes') as a, max(f1) filter (model = 'duration') as b
    from rated group by scenario)
  select scenario, {r('a', 6, 'f1_first')}, {r('b', 6, 'f1_second')},
  case when a > b then 'bytes' else 'duration' end as winner from wide""")
def m16(spark, sf_dir):
    return rounded(metrics.scenario_summary(_scenarios(spark, sf_dir), "bytes", "duration"))


@query("m17_relative_improvement", f"""with {LONG}, {rated_sql('scored', 'model')},
  weekend as (select * from scored where day in ('Saturday', 'Sunday')), {rated_sql('weekend', 'model', 'old')}
  select rated.model, {r('rated.f1', 6, 'new_value')}, {r('old.f1', 6, 'old_value')},
  {r('(rated.f1 - old.f1) / old.f1 * 100', 4, 'improvement_percent')} from rated join old on rated.model = old.model""")
def m17(spark, sf_dir):
    df = scored(spark, sf_dir)
    new = metrics.classification_metrics(df, ["model"])
    old = metrics.classification_metrics(df.where(F.col("day").isin("Saturday", "Sunday")), ["model"])
    return rounded(metrics.relative_improvement(new, old), 6, improvement_percent=4)


def _trials_sql(percentiles, benign_only: bool) -> str:
    where = "where label = 0" if benign_only else ""
    cuts = " union all ".join(
        f"select model, {p} as percentile, quantile_cont(anomaly_score, {p / 100}) as cut from scored {where} group by model"
        for p in percentiles)
    return f"""cuts as ({cuts}), trials as (select s.model, percentile::integer as percentile, cut as threshold, label,
    case when anomaly_score > cut then 1 else 0 end as prediction from scored s join cuts c on s.model = c.model),
    {rated_sql('trials', 'model, percentile, threshold')}"""


TRIAL_COLUMNS = ["precision", "recall", "f1", "fpr"]


@query("m18_threshold_sensitivity", f"""with {LONG}, {_trials_sql((90, 95, 99), True)}
  select model, percentile, {r('threshold', 4, 'threshold')}, tp, fp, fn, {rounded_sql(TRIAL_COLUMNS)} from rated""")
def m18(spark, sf_dir):
    trials = metrics.threshold_trials(keep(scored(spark, sf_dir)), metrics.SENSITIVITY_PERCENTILES, benign_only=True)
    return rounded(trials.select("model", "percentile", "threshold", "tp", "fp", "fn", *TRIAL_COLUMNS), 6, threshold=4)


@query("m19_optimise_threshold", f"""with {LONG}, {_trials_sql((90, 92, 95, 97, 99), False)}, ranked as (
    select *, row_number() over (partition by model order by f1 desc, percentile) as place from rated)
  select model, percentile, {r('threshold', 4, 'threshold')}, {rounded_sql(['precision', 'recall', 'f1'])}
  from ranked where place = 1""")
def m19(spark, sf_dir):
    trials = metrics.threshold_trials(keep(scored(spark, sf_dir)), metrics.SEARCH_PERCENTILES, benign_only=False)
    return rounded(metrics.best_threshold(trials), 6, threshold=4)


@query("m20_diagnosis", f"""with {LONG}, {rated_sql('scored', 'model')},
  weekend as (select * from scored where day in ('Saturday', 'Sunday')), {rated_sql('weekend', 'model', 'old')},
  joined as (select rated.model, rated.f1, rated.recall, rated.fpr, old.f1 + 0.5 as expected_f1,
    old.recall as expected_recall, old.fpr as expected_fpr from rated join old on rated.model = old.model)
  select model, {rounded_sql(['f1', 'recall', 'fpr', 'expected_f1', 'expected_recall', 'expected_fpr'])},
  {r('f1 - expected_f1', 6, 'diff_f1')}, {r('recall - expected_recall', 6, 'diff_recall')},
  {r('fpr - expected_fpr', 6, 'diff_fpr')},
  case when abs(f1 - expected_f1) < 0.05 then 'matches expected' when recall < 0.10 then 'recall extremely low'
    when fpr > 0.50 then 'false positive rate extremely high' else 'differs' end as diagnosis from joined""")
def m20(spark, sf_dir):
    df = scored(spark, sf_dir)
    actual = metrics.classification_metrics(df, ["model"])
    expected = metrics.classification_metrics(df.where(F.col("day").isin("Saturday", "Sunday")), ["model"])
    return rounded(metrics.diagnose(actual, expected.withColumn("f1", F.col("f1") + 0.5)))


@query("m21_hardest_attacks", f"""with {LONG}, {PER_CLASS} select attack_type,
  {r('avg(detection_rate)', 6, 'mean_detection_rate')} from per_class where attack_type <> 'BENIGN'
  group by attack_type order by 2, 1 limit 3""")
def m21(spark, sf_dir):
    return rounded(metrics.hardest_attacks(metrics.per_class(scored(spark, sf_dir))))


# A grid over the given flows: two rules (kernel), three cut-offs (nu), graded by F1.
GRID_NU = (0.05, 0.10, 0.25)


def _grid_frame(spark, sf_dir):
    df = keep(scored(spark, sf_dir))
    trials = metrics.threshold_trials(df, tuple(round(100 * (1 - nu)) for nu in GRID_NU), benign_only=True)
    return trials.select(F.col("model").alias("kernel"), (F.lit(100) - F.col("percentile")).alias("nu"),
                         F.lit("scale").alias("gamma"), "f1", "precision", "recall")


GRID = f"""{_trials_sql((95, 90, 75), True)}, grid as (select model as kernel, 100 - percentile as nu, 'scale' as gamma,
  f1, precision, recall from rated)"""


@query("m22_grid_best_by_kernel", f"""with {LONG}, {GRID} select kernel, {r('max(f1)', 6, 'best_f1')} from grid
  group by kernel""")
def m22(spark, sf_dir):
    return rounded(metrics.grid_analysis(_grid_frame(spark, sf_dir))["best_by_parameter"])


@query("m22_grid_best_by_both", f"""with {LONG}, {GRID} select kernel, nu, {r('max(f1)', 6, 'best_f1')} from grid
  group by kernel, nu""")
def m22_both(spark, sf_dir):
    return rounded(metrics.grid_analysis(_grid_frame(spark, sf_dir))["best_by_both"])


@query("m22_grid_first_by_nu", f"""with {LONG}, {GRID} select kernel, nu, gamma, {rounded_sql(['f1', 'precision', 'recall'])}
  from (select *, row_number() over (partition by nu order by kernel, gamma) as place from grid) where place = 1""")
def m22_first(spark, sf_dir):
    return rounded(metrics.grid_analysis(_grid_frame(spark, sf_dir))["first_by_second"])


@query("m22_grid_top", f"""with {LONG}, {GRID} select kernel, nu, gamma, {rounded_sql(['f1', 'precision', 'recall'])}
  from (select * from grid order by grid.f1 desc, nu, kernel limit 5)""")
def m22_top(spark, sf_dir):
    return rounded(metrics.grid_analysis(_grid_frame(spark, sf_dir))["top"])


@query("m23_batch_summary", f"""with {LONG} select model, count(*) as total, count(*) filter (prediction = 1) as attacks,
  count(*) filter (prediction = 0) as benign, 0::bigint as errors,
  {r("count(*) filter (prediction = 1) * 100.0 / count(*)", 6, "anomaly_rate_percent")} from scored group by model""")
def m23(spark, sf_dir):
    from flowlens.operators.schema import label_text

    df = scored(spark, sf_dir).withColumn("prediction_label", label_text(F.col("prediction")))
    return rounded(metrics.batch_summary(df, ["model"]))


@query("x8_importance_table", f"""with {SIGNAL}, importance as (
  select 'flow_duration' as feature, stddev_pop(flow_duration) / avg(flow_duration) as importance from signal
  union all select 'total_bytes', stddev_pop(total_bytes) / avg(total_bytes) from signal
  union all select 'iat_mean', stddev_pop(iat_mean) / avg(iat_mean) from signal)
  select feature, {r('importance', 6, 'importance')} from importance order by importance.importance desc limit 2""")
def x8(spark, sf_dir):
    from flowlens.operators.scale import feature_moments

    moments = feature_moments(flows_signal(spark, sf_dir), ["flow_duration", "total_bytes", "iat_mean"])
    return rounded(metrics.importance_table(moments.select("feature", (F.col("std") / F.col("mean")).alias(
        "importance")), 2))
