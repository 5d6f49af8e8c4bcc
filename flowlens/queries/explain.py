"""Explanation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.detect import autoencoder, forest, registry
from flowlens.detect.base import matrix_column, prepared
from flowlens.operators import explain, schema
from flowlens.queries.detect import (
    FOUR, GIVEN_LAYERS, GIVEN_THETA, LINEAR_SCORE, LINEAR_WEIGHTS, SCALED, THREE, _clean_signal, _given_forest,
    _linear_svm, _scaler, _three,
)
from flowlens.queries.registry import KEYS, SIGNAL, md5_of, query, r, rounded
from flowlens.sources.views import FLOW_KEYS, flows_signal

BACKGROUND = SCALED + f""", background as (select avg(x0) as b0, avg(x1) as b1, avg(x2) as b2 from (
    select x0, x1, x2 from scaled where label = 'BENIGN' order by {md5_of()}, {KEYS} limit 100)),
  phis as (select scaled.*, 0.5 * (x0 - b0) as p0, -1.25 * (x1 - b1) as p1, 2.0 * (x2 - b2) as p2,
    0.5 * b0 - 1.25 * b1 + 2.0 * b2 - 0.25 as base, {LINEAR_SCORE} as raw, row_number() over () as rid
    from scaled cross join background)"""


def _explained(spark, sf_dir):
    """Kernel contributions of a linear decision: SQL knows them in closed form."""
    df = _three(spark, sf_dir)
    return explain.explain_model(df, _linear_svm(df), schema.filter_benign(df), FLOW_KEYS)


@query("x1_kernel_shap", f"""with {BACKGROUND} select {KEYS}, {r("p0", 5, "phi_flow_duration")},
  {r("p1", 5, "phi_total_bytes")}, {r("p2", 5, "phi_iat_mean")} from phis""")
def x1(spark, sf_dir):
    return rounded(_explained(spark, sf_dir).select(
        *FLOW_KEYS, *[F.col("shap")[i].alias(f"phi_{f}") for i, f in enumerate(THREE)]), 5)


@query("x1_linear_shap", f"""with {SCALED} select {KEYS}, {r("0.5 * x0", 6, "phi_flow_duration")},
  {r("-1.25 * x1", 6, "phi_total_bytes")}, {r("2.0 * x2", 6, "phi_iat_mean")} from scaled""")
def x1_linear(spark, sf_dir):
    df = _three(spark, sf_dir)
    scaled = _scaler(df).transform(df.fillna(0.0, ["iat_mean"]))
    out = explain.explain_linear(scaled, LINEAR_WEIGHTS, dict.fromkeys(THREE, 0.0))
    return rounded(out.select(*FLOW_KEYS, *[F.col("shap")[i].alias(f"phi_{f}") for i, f in enumerate(THREE)]))


RANKED = BACKGROUND + f""", long_phis as (
  select {KEYS}, rid, raw, 0 as i, 'flow_duration' as feature, p0 as phi, flow_duration as v from phis
  union all select {KEYS}, rid, raw, 1, 'total_bytes', p1, total_bytes from phis
  union all select {KEYS}, rid, raw, 2, 'iat_mean', p2, iat_mean from phis),
  ranked as (select *, row_number() over (partition by rid order by abs(phi) desc, i) as place from long_phis)"""


@query("x2_top_features", f"""with {RANKED} select {KEYS}, place::integer as place, feature, {r("phi", 5, "shap_value")},
  {r("v", 5, "feature_value")}, {r("abs(phi)", 5, "importance")} from ranked where place <= 2""")
def x2(spark, sf_dir):
    top = explain.top_features(THREE, F.col("shap"), 2)
    out = _explained(spark, sf_dir).select(*FLOW_KEYS, F.posexplode(top).alias("place", "t"))
    return rounded(out.select(*FLOW_KEYS, (F.col("place") + 1).alias("place"), "t.*"), 5)


@query("x3_explain_batch", f"""with {RANKED} select {KEYS}, {r("max(raw)", 5, "anomaly_score")},
  case when max(raw) < 0 then 1 else 0 end as prediction,
  max(feature) filter (place = 1) as top_1_feature, {r("max(phi) filter (place = 1)", 5, "top_1_contribution")},
  {r("max(v) filter (place = 1)", 5, "top_1_value")}, max(feature) filter (place = 2) as top_2_feature,
  {r("max(phi) filter (place = 2)", 5, "top_2_contribution")}, {r("max(v) filter (place = 2)", 5, "top_2_value")}
  from ranked group by rid, {KEYS}""")
def x3(spark, sf_dir):
    df = _three(spark, sf_dir)
    model = _linear_svm(df)
    scored = model.transform(df).withColumn("anomaly_score", F.col("raw_score"))
    explained = explain.explain_model(scored, model, schema.filter_benign(df), FLOW_KEYS)
    return rounded(explain.explain_batch(explained, THREE, 2, keep=[*FLOW_KEYS, "anomaly_score", "prediction"]), 5)


@query("x4_summary", f"""with {BACKGROUND}, means as (select 'flow_duration' as feature, avg(abs(p0)) as m from phis
  union all select 'total_bytes', avg(abs(p1)) from phis union all select 'iat_mean', avg(abs(p2)) from phis)
  select feature, {r("m", 6, "mean_abs_shap")} from means""")
def x4(spark, sf_dir):
    return rounded(explain.summary(_explained(spark, sf_dir), THREE))


@query("x5_base_value", f"""with {BACKGROUND} select {KEYS}, {r("base", 6, "expected_value")},
  {r("base + p0 + p1 + p2", 5, "score_from_parts")} from phis""")
def x5(spark, sf_dir):
    parts = F.col("expected_value") + F.col("shap")[0] + F.col("shap")[1] + F.col("shap")[2]
    return rounded(_explained(spark, sf_dir).select(*FLOW_KEYS, "expected_value", parts.alias("score_from_parts")),
                   6, score_from_parts=5)


@query("x6_tree_shap")
def x6(spark, sf_dir):
    df = _clean_signal(spark, sf_dir)
    model = forest.IsolationForest(FOUR, FLOW_KEYS).fit(schema.filter_benign(df))
    return explain.explain_model(df, model, df, FLOW_KEYS).select(*FLOW_KEYS, "shap", "expected_value")


# Whatever the trees, base value and contributions add up to the row's mean path length.
@query("x6_tree_shap_additive", f"""with {SIGNAL} select {KEYS}, 4::int as n_values, 0.0::double as residual from signal""")
def x6_additive(spark, sf_dir):
    df = flows_signal(spark, sf_dir, heavy=True)
    model = forest.IsolationForest(FOUR, FLOW_KEYS).fit(schema.filter_benign(df))
    path = matrix_column(model.path_length(), prepared(FOUR, model.scaler))
    total = F.aggregate("shap", F.col("expected_value"), lambda a, b: a + b)
    return explain.explain_forest(df, model).select(
        *FLOW_KEYS, F.size("shap").alias("n_values"), F.abs(F.round(total - path, 6)).alias("residual"))


# The two given trees have the features flow_duration and total_bytes: Shapley values of two players in closed form.
def _tree_sql() -> str:
    def path(depth, size):
        return float(depth + forest.average_path(size))

    a = {"deep": 60 / 64, "left": 31 / 60, "b": {"v1": path(2, 31), "v2": path(2, 29), "v3": path(1, 4)}}
    c = {"low": 50 / 64, "small": 12 / 14, "v1": path(1, 50), "v2": path(2, 12), "v3": path(2, 2)}
    # first tree: value by (total_bytes side, flow_duration side)
    known_both_a = (f"case when total_bytes <= 60000.0 then case when flow_duration <= 25.0 then {a['b']['v1']!r} "
                    f"else {a['b']['v2']!r} end else {a['b']['v3']!r} end")
    inner = a["left"] * a["b"]["v1"] + (1 - a["left"]) * a["b"]["v2"]
    only_bytes_a = f"case when total_bytes <= 60000.0 then {inner!r} else {a['b']['v3']!r} end"
    only_duration_a = (f"({a['deep']!r} * case when flow_duration <= 25.0 then {a['b']['v1']!r} else {a['b']['v2']!r} end "
                       f"+ {(1 - a['deep']) * a['b']['v3']!r})")
    none_a = a["deep"] * inner + (1 - a["deep"]) * a["b"]["v3"]
    known_both_c = (f"case when flow_duration <= 40.0 then {c['v1']!r} else case when total_bytes <= 90000.0 "
                    f"then {c['v2']!r} else {c['v3']!r} end end")
    rest = c["small"] * c["v2"] + (1 - c["small"]) * c["v3"]
    only_duration_c = f"case when flow_duration <= 40.0 then {c['v1']!r} else {rest!r} end"
    only_bytes_c = (f"({c['low'] * c['v1']!r} + {1 - c['low']!r} * case when total_bytes <= 90000.0 then {c['v2']!r} "
                    f"else {c['v3']!r} end)")
    none_c = c["low"] * c["v1"] + (1 - c["low"]) * rest
    both = f"(({known_both_a}) + ({known_both_c}))::double / 2"
    bytes_ = f"(({only_bytes_a}) + ({only_bytes_c}))::double / 2"
    duration = f"(({only_duration_a}) + ({only_duration_c}))::double / 2"
    none = repr((none_a + none_c) / 2)
    phi_duration = f"0.5 * (({duration}) - {none}) + 0.5 * (({both}) - ({bytes_}))"
    phi_bytes = f"0.5 * (({bytes_}) - {none}) + 0.5 * (({both}) - ({duration}))"
    from flowlens.queries.registry import SIGNAL

    return f"""with {SIGNAL} select {KEYS}, {r(phi_duration, 6, 'phi_flow_duration')},
  {r(phi_bytes, 6, 'phi_total_bytes')}, {r(none + '::double', 6, 'expected_value')} from signal"""


@query("x6_tree_shap_given", _tree_sql())
def x6_given(spark, sf_dir):
    df = flows_signal(spark, sf_dir, heavy=True)
    out = explain.explain_forest(df, _given_forest(spark))
    return rounded(out.select(*FLOW_KEYS, F.col("shap")[0].alias("phi_flow_duration"),
                              F.col("shap")[1].alias("phi_total_bytes"), "expected_value"))


@query("x7_gradient_shap")
def x7(spark, sf_dir):
    df = _three(spark, sf_dir)
    model = autoencoder.AutoencoderModel.from_weights(GIVEN_LAYERS, GIVEN_THETA, THREE, _scaler(df), 1)
    return explain.explain_model(df, model, schema.filter_benign(df), FLOW_KEYS, n_background=20).select(
        *FLOW_KEYS, "shap", "expected_value")


@query("x1_user_scorer", f"""with {BACKGROUND} select {KEYS}, {r("2.0 * (x1 - b1)", 5, "phi_total_bytes")} from phis
  cross join background""")
def x1_user(spark, sf_dir):
    df = _three(spark, sf_dir)
    scaler = _scaler(df)
    score = explain.frame_scorer(lambda rows: 2.0 * rows["total_bytes"] + 1.0, THREE)
    background = explain.background_matrix(schema.filter_benign(df), THREE, FLOW_KEYS, 100, 42, scaler)
    out = explain.explain(df, THREE, score, background, scaler=scaler)
    return rounded(out.select(*FLOW_KEYS, F.col("shap")[1].alias("phi_total_bytes")), 5)


@query("d25_score_flows_explained", f"""with {RANKED} select {KEYS},
  case when raw < 0 then 'ATTACK' else 'BENIGN' end as prediction_label, feature as top_feature
  from ranked where place = 1""")
def d25_explained(spark, sf_dir):
    df = _three(spark, sf_dir)
    model = _linear_svm(df)
    explained = explain.explain_model(df, model, schema.filter_benign(df), FLOW_KEYS).withColumn(
        "top_features", explain.top_features(THREE, F.col("shap")))
    scored = registry.score_flows(explained, model, F.col("top_features")[0]["feature"])
    return scored.select(*FLOW_KEYS, "prediction_label", F.col("top_features")[0]["feature"].alias("top_feature"))
