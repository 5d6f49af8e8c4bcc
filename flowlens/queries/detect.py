"""Detector queries. Where a model is given rather than trained, SQL computes the same scores; trained models are
checked by properties in the tests and return whole result tables here."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from flowlens.detect import autoencoder, forest, network, ocsvm, registry, vae
from flowlens.detect.base import UserModel
from flowlens.operators import metrics, sampling, schema
from flowlens.operators.clean import FlowCleaner
from flowlens.operators.quantiles import exact_percentiles
from flowlens.operators.scale import FlowScaler
from flowlens.queries.registry import KEYS, ORACLES, SIGNAL, md5_of, query, r, rounded
from flowlens.session import keep, scratch_path
from flowlens.sources.views import FLOW_KEYS, VECTOR_FEATURES, flows_signal, vectors

THREE = ["flow_duration", "total_bytes", "iat_mean"]
FOUR = ["flow_duration", "total_bytes", "bytes_per_s", "iat_mean"]

SCALED = SIGNAL + ", scale as (select " + ", ".join(
    f"avg({f}) as m_{f}, stddev_pop({f}) as s_{f}" for f in THREE) + " from signal where label = 'BENIGN'), scaled as (" \
    "select l_orderkey, l_partkey, l_suppkey, l_linenumber, label, day, flow_duration, total_bytes, iat_mean, " + ", ".join(
    f"(coalesce({f}, 0.0) - m_{f}) / s_{f} as x{i}" for i, f in enumerate(THREE)) + " from signal cross join scale)"


def _scaler(df):
    return FlowScaler(THREE).fit(schema.filter_benign(df))


def _clean_signal(spark, sf_dir):
    """Signal flows with infinite rates and missing values filled; statistics are learned on benign flows."""
    df = flows_signal(spark, sf_dir, heavy=True).drop("const_zero", "day")
    cleaner = FlowCleaner(FOUR, handle_nan="median", remove_duplicates=False, remove_constant=False,
                          keep=FLOW_KEYS).fit(schema.filter_benign(df))
    return keep(cleaner.transform(df))


def _detection(scored, model: str):
    return metrics.per_attack(scored.withColumns({"label_original": F.col("label"), "model": F.lit(model)}), ["model"])


# ---- flagship ------------------------------------------------------------------------------------------------------

COMPONENTS = 32
FLAGSHIP_GAMMA = 0.5


def _flagship_map():
    return ocsvm.FeatureMap("rbf", len(THREE), FLAGSHIP_GAMMA, COMPONENTS, 3, 0.0, 42)


def _z_sql() -> list[str]:
    fmap = _flagship_map()
    return [
        f"sqrt(2.0 / {COMPONENTS}) * cos(" + " + ".join(
            f"x{i} * ({float(fmap.arrays["frequencies"][i, k])!r}::double)" for i in range(len(THREE)))
        + f" + ({float(fmap.arrays["phases"][k])!r}::double))" for k in range(COMPONENTS)]


MAPPED = SCALED + ", mapped as (select *, " + ", ".join(
    f"{z} as z{k}" for k, z in enumerate(_z_sql())) + " from scaled), center as (select " + ", ".join(
    f"avg(z{k}) as w{k}" for k in range(COMPONENTS)) + " from mapped where label = 'BENIGN'), similarity as (select " + \
    "l_orderkey, l_partkey, l_suppkey, l_linenumber, label, " + " + ".join(
    f"z{k} * w{k}" for k in range(COMPONENTS)) + " as s from mapped cross join center)"

DECIDED = MAPPED + """, decided as (select *, s - (select median(s) from similarity where label = 'BENIGN') as raw_score
  from similarity), flagged as (select *, case when -raw_score >
  (select quantile_cont(-raw_score, 0.95) from decided where label = 'BENIGN') then 1 else 0 end as prediction
  from decided)"""


def _flagship(spark, sf_dir):
    df = flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")
    benign = schema.filter_benign(df)
    model = ocsvm.OneClassSVM(THREE, nu=1.0, gamma=FLAGSHIP_GAMMA, n_components=COMPONENTS).fit(benign)
    return keep(model.transform(df))


@query("detect_per_attack", f"""with {DECIDED} select label as attack_type, count(*) as samples,
  count(*) filter (prediction = 1) as detected, count(*) filter (prediction = 0) as missed,
  {r("avg(prediction)", 6, "detection_rate")} from flagged where label <> 'BENIGN' group by label""")
def detect_per_attack(spark, sf_dir):
    scored = _flagship(spark, sf_dir)
    benign = schema.filter_benign(scored)
    threshold = exact_percentiles(benign, ["anomaly_score"], [0.95])[("anomaly_score", 0.95)]
    flagged = scored.withColumns({"prediction": (F.col("anomaly_score") > threshold).cast("int"),
                                  "label_original": F.col("label")})
    return rounded(metrics.per_attack(flagged).select("attack_type", "samples", "detected", "missed",
                                                      "detection_rate"))


@query("d5_svm_nu_one", f"""with {DECIDED} select {KEYS}, {r("raw_score", 6, "raw_score")},
  {r("-raw_score", 6, "anomaly_score")}, case when raw_score < 0 then 1 else 0 end as prediction from decided""")
def d5_nu_one(spark, sf_dir):
    return rounded(_flagship(spark, sf_dir).select(*FLOW_KEYS, "raw_score", "anomaly_score", "prediction"))


# ---- forest --------------------------------------------------------------------------------------------------------

# Two given trees over flow_duration (0) and total_bytes (1).
GIVEN_NODES = pd.DataFrame(
    [(0, 0, 1, 60000.0, 1, 2, 64, 0), (0, 1, 0, 25.0, 3, 4, 60, 1), (0, 2, -1, 0.0, 2, 2, 4, 1),
     (0, 3, -1, 0.0, 3, 3, 31, 2), (0, 4, -1, 0.0, 4, 4, 29, 2),
     (1, 0, 0, 40.0, 1, 2, 64, 0), (1, 1, -1, 0.0, 1, 1, 50, 1), (1, 2, 1, 90000.0, 3, 4, 14, 1),
     (1, 3, -1, 0.0, 3, 3, 12, 2), (1, 4, -1, 0.0, 4, 4, 2, 2)],
    columns=["tree", "node", "feature", "threshold", "left", "right", "size", "depth"])


def _path(depth: int, size: int) -> str:
    return repr(float(depth + forest.average_path(size)))


GIVEN_SCORE = f"""given as (select *,
    (case when total_bytes <= 60000.0 then case when flow_duration <= 25.0 then {_path(2, 31)} else {_path(2, 29)} end
      else {_path(1, 4)} end
    + case when flow_duration <= 40.0 then {_path(1, 50)} else case when total_bytes <= 90000.0 then {_path(2, 12)}
      else {_path(2, 2)} end end)::double / 2 as path from signal), forest as (
  select *, -pow(2.0, -path / {float(forest.average_path(64))!r}) as raw_score from given)"""


def _given_forest(spark):
    return forest.IsolationForestModel.from_nodes(
        spark.createDataFrame(GIVEN_NODES, forest.NODES), ["flow_duration", "total_bytes"], 64, threshold=-0.5)


@query("d2_forest_score", f"""with {SIGNAL}, {GIVEN_SCORE}, cut as (select quantile_cont(raw_score, 0.1) as c from forest)
  select {KEYS}, {r("raw_score", 6, "raw_score")}, {r("raw_score - c", 6, "decision")},
  case when raw_score - c < 0 then 1 else 0 end as prediction from forest cross join cut""")
def d2(spark, sf_dir):
    model = _given_forest(spark)
    scored = keep(model.transform(flows_signal(spark, sf_dir, heavy=True)))
    model.threshold = exact_percentiles(scored, ["raw_score"], [0.1])[("raw_score", 0.1)]
    raw = F.col("raw_score")
    return rounded(scored.select(*FLOW_KEYS, "raw_score", model.decision(raw).alias("decision"),
                                 model.prediction(raw).alias("prediction")))


@query("d3_forest_probability", f"""with {SIGNAL}, {GIVEN_SCORE}
  select {KEYS}, {r("1.0 / (1.0 + exp(5.0 * (raw_score + 0.5)))", 6, "anomaly_probability")} from forest""")
def d3(spark, sf_dir):
    scored = _given_forest(spark).transform(flows_signal(spark, sf_dir, heavy=True))
    return rounded(scored.select(*FLOW_KEYS, "anomaly_probability"))


@query("d4_split_importance", """with splits as (select l_linenumber - 2 as feature from lineitem),
  names as (select unnest(['f0', 'f1', 'f2', 'f3', 'f4', 'f5']) as feature, unnest([0, 1, 2, 3, 4, 5]) as i),
  counts as (select feature, count(*) as n from splits where feature >= 0 group by feature)
  select names.feature, round(coalesce(n, 0) / (select sum(n) from counts), 6) + 0.0 as importance
  from names left join counts on counts.feature = i""")
def d4(spark, sf_dir):
    splits = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_linenumber") - 2).alias("feature"))
    return rounded(forest.split_importance(splits, [f"f{i}" for i in range(6)]))


@query("d1_isolation_forest")
def d1(spark, sf_dir):
    df = _clean_signal(spark, sf_dir)
    model = forest.IsolationForest(FOUR, FLOW_KEYS, n_trees=100, contamination=0.05).fit(schema.filter_benign(df))
    return _detection(model.transform(df), "forest")


@query("d4_forest_importance")
def d4_trained(spark, sf_dir):
    df = vectors(spark, sf_dir)
    model = forest.IsolationForest(VECTOR_FEATURES, ["vec_id"], n_trees=50).fit(schema.filter_benign(df))
    return model.feature_importance(spark)


# ---- one-class SVM -------------------------------------------------------------------------------------------------

@query("d5_one_class_svm")
def d5(spark, sf_dir):
    df = _clean_signal(spark, sf_dir)
    model = ocsvm.OneClassSVM(FOUR, nu=0.05).fit(schema.filter_benign(df))
    return _detection(model.transform(df), "ocsvm")


@query("d6_gamma_rule", f"""with {SIGNAL}, entries as (select unnest([flow_duration, total_bytes / 1000, iat_mean * 100]) as v
    from signal)
  select {r("1.0 / (3 * var_pop(v))", 8, "gamma_scale")}, {r("1.0 / 3", 8, "gamma_auto")} from entries""")
def d6(spark, sf_dir):
    df = flows_signal(spark, sf_dir).select(
        "flow_duration", (F.col("total_bytes") / 1000).alias("total_bytes"), (F.col("iat_mean") * 100).alias("iat_mean"))
    return rounded(ocsvm.gamma_table(df, THREE), 8)


def _kernel_sql(expression: str, n: int) -> str:
    return f"""with {SCALED}, support as (select x0 as v0, x1 as v1, x2 as v2 from scaled where label = 'BENIGN'
    order by {md5_of()}, {KEYS} limit {n})
  select {KEYS}, {r(f"avg({expression}) - 0.25", 6, "raw_score")} from scaled cross join support group by {KEYS}"""


def _kernel(spark, sf_dir, n, **kernel):
    df = flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")
    scaler = _scaler(df)
    support = sampling.sample_n(schema.filter_benign(df), FLOW_KEYS, n).withColumn("weight", F.lit(1.0 / n))
    return rounded(ocsvm.kernel_decision(df, THREE, support, 0.25, scaler=scaler, **kernel).select(
        *FLOW_KEYS, "raw_score"))


DISTANCE = "((x0 - v0) * (x0 - v0) + (x1 - v1) * (x1 - v1) + (x2 - v2) * (x2 - v2))"
DOT = "(x0 * v0 + x1 * v1 + x2 * v2)"


@query("d7_rbf_decision", _kernel_sql(f"exp(-0.5 * {DISTANCE})", 200))
def d7_rbf(spark, sf_dir):
    return _kernel(spark, sf_dir, 200, kernel="rbf", gamma=0.5)


@query("d7_linear_decision", _kernel_sql(DOT, 20))
def d7_linear(spark, sf_dir):
    return _kernel(spark, sf_dir, 20, kernel="linear")


@query("d7_poly_decision", _kernel_sql(f"pow(0.1 * {DOT} + 1.0, 3)", 20))
def d7_poly(spark, sf_dir):
    return _kernel(spark, sf_dir, 20, kernel="poly", gamma=0.1, coef0=1.0, degree=3)


@query("d7_sigmoid_decision", _kernel_sql(f"tanh(0.1 * {DOT} + 0.5)", 20))
def d7_sigmoid(spark, sf_dir):
    return _kernel(spark, sf_dir, 20, kernel="sigmoid", gamma=0.1, coef0=0.5)


@query("d8_svm_probability", f"""with {SCALED} select {KEYS},
  {r("1.0 / (1.0 + exp(2.0 * (1.0 - x1)))", 6, "anomaly_probability")} from scaled""")
def d8(spark, sf_dir):
    df = flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")
    scaled = _scaler(df).transform(df)
    return rounded(scaled.select(*FLOW_KEYS, ocsvm.svm_probability(1.0 - F.col("total_bytes")).alias(
        "anomaly_probability")))


@query("d9_support_report")
def d9(spark, sf_dir):
    benign = schema.filter_benign(_clean_signal(spark, sf_dir))
    return ocsvm.OneClassSVM(FOUR, nu=0.1).fit(benign).support_report(benign)


# What holds of the dual coefficients of any fit: each lies above 0 and within 1 / (nu n), they sum to 1, at least nu of the
# rows have one, and the rows' images weighted by them are the model's weights.
@query("d9_support_vectors", f"""with {SIGNAL}, benign as (select count(*) as n from signal where label = 'BENIGN')
  select kernel, n as training_rows, true as within_bounds, 1.0::double as coefficient_sum, true as enough,
    true as weights_match, true as gap_closed from benign, (values ('rbf'), ('linear'), ('poly')) k(kernel)""")
def d9_support_vectors(spark, sf_dir):
    nu = 0.1
    benign = keep(schema.filter_benign(flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")))
    kernels = ["rbf", "linear", "poly"]
    models = ocsvm.fit_all(benign, [ocsvm.OneClassSVM(THREE, nu=nu, kernel=k, degree=2, coef0=1.0) for k in kernels])
    made = []
    for kernel, model in zip(kernels, models):
        # linear: the mean of scaled features is 0, so the shortest vector has no length worth a share
        away, length = np.linalg.norm(model.support_sum(benign) - model.weights), np.linalg.norm(model.weights)
        a, n = F.col("coefficient"), F.lit(model.n_rows)
        made.append(model.support_vectors(benign, FLOW_KEYS).agg(
            F.lit(kernel).alias("kernel"), n.cast("long").alias("training_rows"),
            ((F.min(a) > 0) & (F.max(a) <= 1.000001 / (nu * n))).alias("within_bounds"),
            F.round(F.sum(a), 9).alias("coefficient_sum"), (F.count("*") >= nu * n).alias("enough"),
            F.lit(bool(away <= 1e-6 * length + 1e-9)).alias("weights_match"),
            F.lit(bool(model.gap <= 1e-3 * length**2 + 1e-9)).alias("gap_closed")))
    return reduce(DataFrame.unionByName, made)


# The polynomial kernel over 64 features and a constant: 47,905 monomials, so the map is a tensor sketch.
@query("d5_svm_poly_wide")
def d5_poly_wide(spark, sf_dir):
    df = vectors(spark, sf_dir)
    model = ocsvm.OneClassSVM(VECTOR_FEATURES, nu=0.1, kernel="poly", degree=3, coef0=1.0).fit(schema.filter_benign(df))
    flagged = model.transform(df).groupBy("label").agg(F.avg("prediction").alias("flagged_share"))
    return flagged.withColumns({"kernel_error": F.lit(model.kernel_error(df)), "gap": F.lit(float(model.gap)),
                                "rounds": F.lit(model.rounds), "components": F.lit(len(model.weights))})


@query("d10_weight_importance", f"""with {SIGNAL}, weights as (
  select label as feature, avg(flow_duration) - 25.0 as weight from signal group by label
  union all select day, 25.0 - avg(flow_duration) from signal group by day)
  select feature, {r("abs(weight) / (select sum(abs(weight)) from weights)", 6, "importance")} from weights""")
def d10(spark, sf_dir):
    df = flows_signal(spark, sf_dir)
    weights = df.groupBy(F.col("label").alias("feature")).agg((F.avg("flow_duration") - 25.0).alias("weight")).unionByName(
        df.groupBy(F.col("day").alias("feature")).agg((25.0 - F.avg("flow_duration")).alias("weight")))
    return rounded(ocsvm.weight_importance(weights))


LINEAR_WEIGHTS = {"flow_duration": 0.5, "total_bytes": -1.25, "iat_mean": 2.0}


def _linear_svm(df, rho=0.25):
    model = ocsvm.OneClassSVMModel()
    model.features, model.scaler, model.threshold = THREE, _scaler(df), 0.0
    model.fmap = ocsvm.FeatureMap("linear", 3, 1.0, 0, 3, 0.0, 42)
    model.weights, model.rho = np.array(list(LINEAR_WEIGHTS.values())), rho
    model.nu, model.rounds, model.n_rows, model.seed, model.gap = 0.5, 0, 0, 42, 0.0
    return model


LINEAR_SCORE = "0.5 * x0 - 1.25 * x1 + 2.0 * x2 - 0.25"


@query("d11_permutation_importance", f"""with {SCALED}, ordered as (select *, row_number() over w - 1 as pos from scaled
    window w as (order by {md5_of()}, {KEYS})),
  n as (select count(*) as n from ordered),
  paired as (select a.x0, a.x1, a.x2, b.x0 as o0, b.x1 as o1, b.x2 as o2
    from ordered a cross join n join ordered b on a.pos = (b.pos + 1) % n.n),
  vars as (select var_pop({LINEAR_SCORE}) as v,
    var_pop(0.5 * o0 - 1.25 * x1 + 2.0 * x2 - 0.25) as v0, var_pop(0.5 * x0 - 1.25 * o1 + 2.0 * x2 - 0.25) as v1,
    var_pop(0.5 * x0 - 1.25 * x1 + 2.0 * o2 - 0.25) as v2 from paired),
  changes as (select 'flow_duration' as feature, abs(v0 - v) as c from vars
    union all select 'total_bytes', abs(v1 - v) from vars union all select 'iat_mean', abs(v2 - v) from vars)
  select feature, {r("c / (select sum(c) from changes)", 5, "importance")} from changes""")
def d11(spark, sf_dir):
    df = flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")
    return rounded(ocsvm.permutation_importance(df, _linear_svm(df), FLOW_KEYS), 5)


def _user_model(df):
    """The same linear decision, given as a function of a pandas frame."""
    def decision(rows):
        return sum(w * rows[f] for f, w in LINEAR_WEIGHTS.items()) - 0.25

    return UserModel(decision, THREE, decision=True, scaler=_scaler(df))


@query("d11_permutation_user_scorer", ORACLES["d11_permutation_importance"])
def d11_user(spark, sf_dir):
    df = flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")
    return rounded(ocsvm.permutation_importance(df, _user_model(df), FLOW_KEYS), 5)


@query("d24_user_scorer", f"""with {SCALED} select {KEYS}, {r(LINEAR_SCORE, 5, "raw_score")},
  case when {LINEAR_SCORE} < 0 then 1 else 0 end as prediction,
  {r(f"least(abs({LINEAR_SCORE}) / 2.0, 1.0)", 5, "confidence")} from scaled""")
def d24_user(spark, sf_dir):
    df = flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")
    scored = registry.score_with(df, _user_model(df), "mine")
    return rounded(scored.select(*FLOW_KEYS, "raw_score", "prediction", "confidence"), 5)


# ---- autoencoders --------------------------------------------------------------------------------------------------

# A given 3-2-3 network: relu bottleneck, linear output.
GIVEN_LAYERS = [network.Dense(3, 2, "relu"), network.Dense(2, 3, "linear", regularised=False)]
GIVEN_W1 = [[0.6, -0.2], [0.3, 0.8], [-0.5, 0.4]]
GIVEN_B1 = [0.1, -0.05]
GIVEN_W2 = [[0.7, 0.2, -0.3], [-0.1, 0.9, 0.5]]
GIVEN_B2 = [0.02, -0.03, 0.04]
GIVEN_THETA = np.concatenate([np.ravel(a) for a in (GIVEN_W1, GIVEN_B1, GIVEN_W2, GIVEN_B2)])


def _dense_sql(inputs: list[str], weights, bias, relu: bool) -> list[str]:
    sums = ["(" + " + ".join(f"{x} * ({weights[i][j]})" for i, x in enumerate(inputs)) + f" + ({bias[j]}))"
            for j in range(len(bias))]
    return [f"greatest({s}, 0.0)" for s in sums] if relu else sums


HIDDEN = _dense_sql(["x0", "x1", "x2"], GIVEN_W1, GIVEN_B1, True)
NETWORK = SCALED + ", hidden as (select *, " + ", ".join(f"({h})::double as h{j}" for j, h in enumerate(HIDDEN)) + \
    " from scaled), rebuilt as (select *, " + ", ".join(
    f"({o})::double as o{j}" for j, o in enumerate(_dense_sql(["h0", "h1"], GIVEN_W2, GIVEN_B2, False))) + \
    " from hidden), errors as (select *, ((o0 - x0) * (o0 - x0) + (o1 - x1) * (o1 - x1) + (o2 - x2) * (o2 - x2)) / 3" \
    " as error from rebuilt)"


def _given_autoencoder(df):
    return autoencoder.AutoencoderModel.from_weights(GIVEN_LAYERS, GIVEN_THETA, THREE, _scaler(df), 1)


def _three(spark, sf_dir):
    return flows_signal(spark, sf_dir, heavy=True).select(*FLOW_KEYS, *THREE, "label")


@query("d13_reconstruction_error", f"with {NETWORK} select {KEYS}, {r('error', 6, 'reconstruction_error')} from errors")
def d13(spark, sf_dir):
    df = _three(spark, sf_dir)
    model = _given_autoencoder(df)
    return rounded(df.select(*FLOW_KEYS, model.raw_score().alias("reconstruction_error")))


ERROR_CUT = "(select quantile_cont(error, 0.95) from errors where label = 'BENIGN')"


@query("d14_percentile_threshold", f"""with {NETWORK} select label, count(*) as samples,
  count(*) filter (error > {ERROR_CUT}) as flagged, {r(ERROR_CUT, 6, "threshold")} from errors group by label""")
def d14(spark, sf_dir):
    df = _three(spark, sf_dir)
    model = _given_autoencoder(df)
    model.set_threshold(schema.filter_benign(df), 95.0)
    return rounded(model.transform(df).groupBy("label").agg(
        F.count("*").alias("samples"), F.sum("prediction").alias("flagged")).withColumn(
        "threshold", F.lit(model.threshold)))


@query("d15_ae_probability", f"""with {NETWORK} select {KEYS},
  {r("1.0 / (1.0 + exp(-5.0 * (error / (2.0 + 1e-10) - 1.0)))", 6, "anomaly_probability")} from errors""")
def d15(spark, sf_dir):
    df = _three(spark, sf_dir)
    model = _given_autoencoder(df)
    model.threshold = 2.0
    return rounded(model.transform(df).select(*FLOW_KEYS, "anomaly_probability"))


@query("d16_latent_vector", f"with {NETWORK} select {KEYS}, {r('h0', 6, 'latent_0')}, {r('h1', 6, 'latent_1')} from hidden")
def d16(spark, sf_dir):
    df = _three(spark, sf_dir)
    latent = _given_autoencoder(df).latent(df)
    return rounded(latent.select(*FLOW_KEYS, F.col("latent")[0].alias("latent_0"), F.col("latent")[1].alias("latent_1")))


@query("d12_autoencoder")
def d12(spark, sf_dir):
    df = _clean_signal(spark, sf_dir)
    model = autoencoder.Autoencoder(FOUR, FLOW_KEYS, encoder=(12, 2), decoder=(2, 12), dropout=0.0, epochs=10).fit(
        schema.filter_benign(df))
    return _detection(model.transform(df), "autoencoder")


# A given variational network: 3 features straight to one latent variable and back.
GIVEN_VAE = {"encoder": [], "mu": [network.Dense(3, 1, "linear")], "log_var": [network.Dense(3, 1, "linear")],
             "decoder": [network.Dense(1, 3, "linear", regularised=False)]}
GIVEN_VAE_THETA = np.array([0.4, 0.5, -0.2, 0.1, 0.05, -0.1, 0.02, -0.3, 0.6, 0.7, -0.4, 0.01, 0.02, -0.03])
MU, LOG_VAR = "(0.4 * x0 + 0.5 * x1 - 0.2 * x2 + 0.1)", "(0.05 * x0 - 0.1 * x1 + 0.02 * x2 - 0.3)"
VAE = SCALED + f""", coded as (select *, {MU}::double as mu, {LOG_VAR}::double as log_var from scaled), vae as (
  select *, (0.6 * mu + 0.01)::double as o0, (0.7 * mu + 0.02)::double as o1, (-0.4 * mu - 0.03)::double as o2 from coded),
  vae_scores as (select *, ((o0 - x0) * (o0 - x0) + (o1 - x1) * (o1 - x1) + (o2 - x2) * (o2 - x2)) / 3 as mse,
    -0.5 * (1 + log_var - mu * mu - exp(log_var)) as kl from vae)"""


def _given_vae(df):
    return vae.VariationalAutoencoderModel.from_weights(GIVEN_VAE, GIVEN_VAE_THETA, THREE, _scaler(df), 0.1,
                                                        threshold=1.5)


@query("d18_vae_score", f"""with {VAE} select {KEYS}, {r("mse + 0.1 * kl", 6, "anomaly_score")},
  case when mse + 0.1 * kl > 1.5 then 1 else 0 end as prediction from vae_scores""")
def d18(spark, sf_dir):
    df = _three(spark, sf_dir)
    return rounded(_given_vae(df).transform(df).select(*FLOW_KEYS, "anomaly_score", "prediction"))


@query("d19_vae_probability", f"""with {VAE} select {KEYS},
  {r("1.0 / (1.0 + exp(-(mse + 0.1 * kl - 1.5) / 0.15))", 6, "attack_probability")},
  {r("1.0 - 1.0 / (1.0 + exp(-(mse + 0.1 * kl - 1.5) / 0.15))", 6, "benign_probability")} from vae_scores""")
def d19(spark, sf_dir):
    df = _three(spark, sf_dir)
    scored = _given_vae(df).transform(df)
    return rounded(scored.select(*FLOW_KEYS, F.col("anomaly_probability").alias("attack_probability"),
                                 (1.0 - F.col("anomaly_probability")).alias("benign_probability")))


@query("d20_vae_reconstruction", f"""with {VAE} select {KEYS}, {r("mse", 6, "reconstruction_error")}, {r("mu", 6, "mu")},
  {r("log_var", 6, "log_var")}, {r("o0 * s_flow_duration + m_flow_duration", 4, "rebuilt_flow_duration")},
  {r("o1 * s_total_bytes + m_total_bytes", 4, "rebuilt_total_bytes")} from vae_scores cross join scale""")
def d20(spark, sf_dir):
    df = _three(spark, sf_dir)
    model = _given_vae(df)
    out = model.reconstruct(model.latent(model.reconstruction_error(df)))
    return rounded(out.select(
        *FLOW_KEYS, "reconstruction_error", F.col("latent_mean")[0].alias("mu"),
        F.col("latent_log_var")[0].alias("log_var"), "rebuilt_flow_duration", "rebuilt_total_bytes"),
        6, rebuilt_flow_duration=4, rebuilt_total_bytes=4)


@query("d17_variational_autoencoder")
def d17(spark, sf_dir):
    df = _clean_signal(spark, sf_dir)
    model = vae.VariationalAutoencoder(FOUR, FLOW_KEYS, latent=2, encoder=(16, 8), epochs=10).fit(
        schema.filter_benign(df))
    return _detection(model.transform(df), "vae")


@query("d17_vae_wide_vectors")
def d17_wide(spark, sf_dir):
    df = vectors(spark, sf_dir)
    model = vae.VariationalAutoencoder(VECTOR_FEATURES, ["vec_id"], epochs=3, batch_size=32).fit(
        schema.filter_benign(df))
    return _detection(model.transform(df), "vae")


@query("d21_training_history")
def d21(spark, sf_dir):
    df = schema.filter_benign(_clean_signal(spark, sf_dir))
    path = scratch_path(spark, "checkpoints")
    model = autoencoder.Autoencoder(FOUR, FLOW_KEYS, encoder=(8, 2), decoder=(2, 8), epochs=6, dropout=0.0,
                                    checkpoint_path=path, checkpoint_every=2).fit(df)
    return model.history_frame(spark)


@query("d22_model_info", """select 'one_class_svm' as kind, 4::integer as n_features, 256::bigint as n_parameters,
  0.0::double as threshold""")
def d22(spark, sf_dir):
    df = schema.filter_benign(_clean_signal(spark, sf_dir))
    return ocsvm.OneClassSVM(FOUR, nu=1.0).fit(df).info(spark).drop("metadata")


# ---- registry and scoring ------------------------------------------------------------------------------------------

@query("s9_save_and_load", f"""with {SIGNAL} select 'forest' as model, count(*) as rows, 0::bigint as different from signal
  union all select 'ocsvm', count(*), 0 from signal union all select 'autoencoder', count(*), 0 from signal
  union all select 'vae', count(*), 0 from signal""")
def s9(spark, sf_dir):
    df = keep(_three(spark, sf_dir))
    models = {"forest": _given_forest(spark), "ocsvm": _linear_svm(df), "autoencoder": _given_autoencoder(df),
              "vae": _given_vae(df)}
    out = None
    for name, model in models.items():
        path = scratch_path(spark, f"model-{name}")
        model.save(spark, path)
        again = registry.load_model(spark, path)
        both = df.select(model.raw_score().alias("a"), again.raw_score().alias("b")).agg(
            F.lit(name).alias("model"), F.count("*").alias("rows"),
            F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))
        out = both if out is None else out.unionByName(both)
    return out


@query("d23_model_registry", f"""with {SIGNAL} select * from (values ('absent', null, false, false),
  ('forest', 'isolation_forest', true, false), ('svm', 'one_class_svm', true, true)) t(name, kind, loaded, is_default)
  where (select count(*) from signal) > 0""")
def d23(spark, sf_dir):
    df = _three(spark, sf_dir)
    paths = {n: scratch_path(spark, f"registry-{n}") for n in ("forest", "svm", "absent")}
    _given_forest(spark).save(spark, paths["forest"])
    _linear_svm(df).save(spark, paths["svm"])
    return registry.ModelRegistry(spark, paths).to_frame().select("name", "kind", "loaded", "is_default")


@query("d24_score_with", f"""with {SCALED}, scores as (select *, {LINEAR_SCORE} as raw from scaled)
  select {KEYS}, 'svm' as model, case when raw < 0 then 1 else 0 end as prediction, {r("raw", 6, "raw_score")},
  {r("least(abs(raw) / 2.0, 1.0)", 6, "confidence")} from scores""")
def d24(spark, sf_dir):
    df = _three(spark, sf_dir)
    scored = registry.score_with(df, _linear_svm(df), "svm")
    return rounded(scored.select(*FLOW_KEYS, "model", "prediction", "raw_score", "confidence"))


SCORED_SQL = f"""scores as (select *, {LINEAR_SCORE} as raw from scaled), reported as (select *,
  case when raw < 0 then 1 else 0 end as prediction, least(100.0, greatest(0.0, abs(raw) * 100.0))::double as confidence
  from scores)"""
ATTACK_TEXT = ("'🚨 ATTACK DETECTED: This network flow shows anomalous behavior. Key indicator: ''' || 'unknown' || "
               "''' deviates significantly from normal patterns. Confidence: ' || printf('%.1f', confidence) || "
               "'%. Recommend blocking or investigating this flow.'")
BENIGN_TEXT = ("'✅ BENIGN TRAFFIC: This network flow appears normal. Confidence: ' || printf('%.1f', confidence) || "
               "'%. All features within expected ranges.'")


@query("d25_score_flows", f"""with {SCALED}, {SCORED_SQL} select {KEYS}, prediction, {r("raw", 6, "raw_score")},
  {r("-raw", 6, "anomaly_score")}, {r("confidence", 4, "confidence")},
  case when prediction = 1 then 'ATTACK' else 'BENIGN' end as prediction_label from reported""")
def d25(spark, sf_dir):
    df = _three(spark, sf_dir)
    scored = registry.score_flows(df, _linear_svm(df))
    return rounded(scored.select(*FLOW_KEYS, "prediction", "raw_score", "anomaly_score", "confidence",
                                 "prediction_label"), 6, confidence=4)


@query("p11_explanation_text", f"""with {SIGNAL}, reported as (select *,
    case when total_bytes > 100000 then 1 else 0 end as prediction, flow_duration * 2 as confidence from signal)
  select {KEYS}, case when prediction = 1 then 'ATTACK' else 'BENIGN' end as prediction_label,
  case when prediction = 1 then {ATTACK_TEXT.replace("'unknown'", "'total_bytes'")} else {BENIGN_TEXT} end as explanation
  from reported""")
def p11(spark, sf_dir):
    prediction = (F.col("total_bytes") > 100000).cast("int")
    return flows_signal(spark, sf_dir).select(
        *FLOW_KEYS, schema.label_text(prediction).alias("prediction_label"),
        schema.explanation_text(prediction, F.lit("total_bytes"), F.col("flow_duration") * 2).alias("explanation"))


@query("d26_error_rows", f"""with {SCALED}, {SCORED_SQL}, labelled as (select *, case when iat_mean is null then 'ERROR'
    when prediction = 1 then 'ATTACK' else 'BENIGN' end as kind from reported)
  select kind as prediction_label, count(*) as flows, {r("sum(case when kind = 'ERROR' then 0.0 else raw end)", 3, "total_score")},
  count(*) filter (kind <> 'ERROR') as predicted from labelled group by kind""")
def d26(spark, sf_dir):
    df = _three(spark, sf_dir)
    scored = registry.score_flows(df, _linear_svm(df), strict=False)
    return rounded(scored.groupBy("prediction_label").agg(
        F.count("*").alias("flows"), F.sum("raw_score").alias("total_score"),
        F.count("prediction").alias("predicted")), 3)


@query("m24_parameter_grid")
def m24(spark, sf_dir):
    from flowlens.plans.training import parameter_grid

    df = _clean_signal(spark, sf_dir)
    return parameter_grid(schema.filter_benign(df), df, FOUR)
