"""Properties of the detectors and explanations."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.detect import network, ocsvm, registry
from flowlens.detect.autoencoder import Autoencoder, AutoencoderModel
from flowlens.detect.base import UserModel, prepared
from flowlens.detect.forest import IsolationForest, average_path
from flowlens.detect.ocsvm import FeatureMap, OneClassSVM, fit_all, kernel_decision, pooled_gamma
from flowlens.detect.svm_solver import shortest
from flowlens.detect.vae import VariationalAutoencoder, VariationalAutoencoderModel
from flowlens.operators import explain
from flowlens.queries.detect import FOUR, _clean_signal
from flowlens.session import keep
from flowlens.sources.views import FLOW_KEYS

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def cloud(spark):
    """A correlated cloud of benign rows and a far cluster of attacks."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(1500, 2))
    benign = np.column_stack([base[:, 0], base[:, 1], base[:, 0] + 0.1 * rng.normal(size=1500)])
    attack = rng.normal(size=(100, 3)) + [6.0, -6.0, -6.0]
    data = [(i, *map(float, row), "BENIGN" if i < 1500 else "DoS") for i, row in enumerate(np.vstack([benign, attack]))]
    df = spark.createDataFrame(data, "id long, a double, b double, c double, label string").repartition(4).cache()
    df.count()
    return df


def benign(df):
    return df.where("label = 'BENIGN'")


def shares(df, model):
    return {r["label"]: r["p"] for r in model.transform(df).groupBy("label").agg(F.avg("prediction").alias("p")).collect()}


def test_average_path():
    assert average_path(1) == 0 and average_path(2) == 1
    assert average_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_forest_meets_contamination_and_ignores_layout(spark, cloud):
    models = [IsolationForest(FEATURES, ["id"], n_trees=20, max_samples=64, contamination=0.1).fit(
        benign(cloud).repartition(n)) for n in (1, 5)]
    assert all(np.array_equal(models[0].table[c], models[1].table[c]) for c in models[0].table)
    got = shares(cloud, models[0])
    assert abs(got["BENIGN"] - 0.1) < 0.02 and got["DoS"] > 0.9
    table = models[0].table
    assert len(np.unique(table["tree"])) == 20
    assert all(table["size"][(table["tree"] == t) & (table["node"] == 0)][0] == 64 for t in range(20))
    importance = models[0].feature_importance(spark)
    assert importance.agg(F.sum("importance")).first()[0] == pytest.approx(1.0)
    uniform = models[0].feature_importance(spark, with_data=False)
    assert {r["importance"] for r in uniform.collect()} == {1 / 3}


def test_forest_sampling_survives_a_hot_group_of_copies(spark):
    df = spark.range(600).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id")).alias("id")).withColumn(
        "a", F.col("id").cast("double"))
    model = IsolationForest(["a"], ["id"], n_trees=10, max_samples=32, contamination="auto").fit(df)
    roots = model.table["size"][model.table["node"] == 0]
    assert len(roots) == 10 and (roots == 32).all()


@pytest.mark.parametrize("kernel,detects", [("rbf", True), ("poly", False), ("linear", False)])
def test_svm_nu_property(cloud, kernel, detects):
    model = OneClassSVM(FEATURES, nu=0.1, kernel=kernel, max_iter=6, coef0=1.0, degree=2).fit(benign(cloud))
    got = shares(cloud, model)
    assert abs(got["BENIGN"] - 0.1) < 0.01
    if detects:
        assert got["DoS"] > 0.9


def test_svm_ends_converged_or_says_so(spark, cloud, tmp_path):
    """Rounds go on until the gap is within tol; a limit that ends them before is no secret."""
    model = OneClassSVM(FEATURES, nu=0.05).fit(benign(cloud))
    assert 0 <= model.gap <= 1e-3 * float(model.weights @ model.weights) and model.metadata()["gap"] == model.gap
    assert model.support_report(cloud).first()["gap"] == model.gap
    with pytest.warns(RuntimeWarning, match="gap .* after 1 rounds"):
        early = OneClassSVM(FEATURES, nu=0.05, max_iter=1).fit(benign(cloud))
    assert early.gap > 1e-3 * float(early.weights @ early.weights)


def test_svm_feature_maps_approximate_their_kernels():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 4))
    rbf = FeatureMap("rbf", 4, 0.3, 8192, 3, 0.0, 1)(x)
    exact = np.exp(-0.3 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(rbf @ rbf.T - exact).max() < 0.08
    poly = FeatureMap("poly", 4, 0.5, 0, 3, 1.0, 1)(x)
    assert np.allclose(poly @ poly.T, (0.5 * x @ x.T + 1.0) ** 3)
    wide = rng.normal(size=(40, 66))
    sketch = FeatureMap("poly", 66, 1 / 66, 4096, 3, 1.0, 1)
    exact = sketch.kernel_of(wide, wide)
    assert sketch.sketched and np.abs(sketch(wide) @ sketch(wide).T - exact).mean() < 0.1 * np.abs(exact).mean()
    with pytest.raises(ValueError):
        FeatureMap("sigmoid", 4, 1.0, 0, 3, 0.0, 1)


def test_svm_dual_coefficients(spark, cloud, tmp_path):
    """They are those of the dual problem: a convex combination within bounds whose rows make up the weights."""
    rows = keep(benign(cloud))
    n = rows.count()
    kernels = [("rbf", 0.05), ("linear", 0.2), ("poly", 0.1), ("rbf", 1.0)]
    models = fit_all(rows, [OneClassSVM(FEATURES, nu=nu, kernel=k, degree=2, coef0=1.0, n_components=64) for k, nu in kernels])
    for (kernel, nu), model in zip(kernels, models):
        got = model.support_vectors(rows, ["id"]).collect()
        a = np.array([r.coefficient for r in got])
        assert len(got) >= nu * n and a.sum() == pytest.approx(1.0, abs=1e-9) and a.min() > 0 and a.max() <= 1.0001 / (nu * n)
        assert len({r.id for r in got}) == len(got)
        assert np.allclose(model.support_sum(rows), model.weights, rtol=1e-6, atol=1e-9)
        by_id = {r.id: np.array(list(r.x)) for r in rows.select("id", prepared(FEATURES, model.scaler).alias("x")).collect()}
        plain = sum(r.coefficient * model.fmap(by_id[r.id][None])[0] for r in got)
        assert np.allclose(plain, model.weights, rtol=1e-6, atol=1e-9)
        alone = OneClassSVM(FEATURES, nu=nu, kernel=kernel, degree=2, coef0=1.0, n_components=64).fit(rows)
        assert np.allclose(alone.weights, model.weights, rtol=1e-6, atol=1e-9) and alone.rho == pytest.approx(model.rho)
    assert models[0].support_report(rows).first()["support_vectors"] >= 0.05 * n
    models[0].save(spark, str(tmp_path / "m"))
    again = registry.load_model(spark, str(tmp_path / "m"))
    assert again.support_vectors(rows, ["id"]).agg(F.sum("coefficient")).first()[0] == pytest.approx(1.0, abs=1e-9)
    assert again.info(spark).first()["n_parameters"] == len(again.weights)


def test_polynomial_svm_on_66_features(spark):
    rng = np.random.default_rng(5)
    names = [f"f{i}" for i in range(66)]
    data = pd.DataFrame(rng.normal(size=(600, 66)), columns=names)
    df = spark.createDataFrame(data)
    model = OneClassSVM(names, nu=0.2, kernel="poly", degree=3, coef0=1.0, tol=0.02).fit(df)
    assert len(model.weights) == ocsvm.SKETCH and model.kernel_error(df) < 0.5
    assert model.transform(df).agg(F.avg("prediction")).first()[0] == pytest.approx(0.2, abs=0.01)


@pytest.mark.parametrize("kernel", ["rbf", "linear", "poly", "sigmoid"])
def test_kernel_decision_in_blocks(spark, cloud, monkeypatch, kernel):
    vectors = cloud.limit(60).withColumn("weight", F.col("id") % 7 / 10.0)
    options = {"kernel": kernel, "gamma": 0.1, "coef0": 0.5, "degree": 2}
    want = {r.id: r.raw_score for r in kernel_decision(cloud, FEATURES, vectors, 0.25, **options).collect()}
    monkeypatch.setattr(ocsvm, "MAX_SENT", 10)
    monkeypatch.setattr(ocsvm, "VECTORS_PER_PASS", 13)
    monkeypatch.setattr(ocsvm, "FLOWS_PER_CHUNK", 100)
    made = kernel_decision(cloud, FEATURES, vectors, 0.25, **options)
    assert made.columns == [*cloud.columns, "raw_score"]
    got = {r.id: r.raw_score for r in made.collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_shortest_vector_of_a_hull():
    atoms = np.array([[2.0, 1.0], [1.0, 2.0], [4.0, 4.0]])
    assert np.allclose(shortest(atoms), [1.5, 1.5], atol=1e-6)


def test_gamma_rules(spark, cloud):
    x = np.array([list(r) for r in cloud.select(*FEATURES).collect()])
    assert pooled_gamma(cloud, FEATURES, "scale") == pytest.approx(1 / (3 * x.var()))
    assert pooled_gamma(cloud, FEATURES, "auto") == pytest.approx(1 / 3)
    assert pooled_gamma(cloud, FEATURES, 0.7) == 0.7


def test_network_gradients():
    rng = np.random.default_rng(5)
    layers = [network.Dense(3, 4, "tanh", True, True), network.Dense(4, 3, "linear", False)]
    theta = network.initial(layers, rng)
    x = rng.normal(size=(16, 3))

    def loss(t):
        params = network.views(layers, t)
        out, _ = network.forward(layers, params, x, np.random.default_rng(0))
        return ((out - x) ** 2).mean() + network.penalty(layers, params, 0.01)

    params = network.views(layers, theta)
    out, caches = network.forward(layers, params, x, np.random.default_rng(0))
    grads, _ = network.backward(layers, params, caches, 2 * (out - x) / x.size, 0.01)
    flat = np.concatenate([g.ravel() for layer in grads for g in layer])
    for i in rng.choice(len(theta), 15, replace=False):
        step = np.zeros_like(theta)
        step[i] = 1e-6
        assert flat[i] == pytest.approx((loss(theta + step) - loss(theta - step)) / 2e-6, abs=1e-5)


def test_batch_statistics_are_those_of_the_batch():
    rng = np.random.default_rng(8)
    layers, x = [network.Dense(3, 4, "relu", True, True)], rng.normal(size=(300, 3))
    params = network.views(layers, network.initial(layers, rng))
    h = np.maximum(x @ params[0][0] + params[0][1], 0.0)
    _, [(_, _, (hat, scale, mean, var), _)] = network.forward(layers, params, x, rng)
    assert (mean == h.mean(0)).all() and (var == h.var(0)).all() and (hat == (h - h.mean(0)) * scale).all()


def test_training_keeps_packed_rows_without_text(spark, cloud, monkeypatch):
    kept = []
    monkeypatch.setattr(network, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    VariationalAutoencoder(FEATURES, ["id"], latent=1, encoder=(4,), epochs=1, shards=2).fit(benign(cloud))
    assert dict(kept[0].dtypes) == {"shard": "int", "held": "binary", "x": "binary"}
    blocks = kept[0].collect()
    assert {b["shard"] for b in blocks} == {0, 1} and len(blocks) < 10 and sum(len(b["held"]) for b in blocks) == 1500
    assert all(len(b["x"]) == 8 * len(FEATURES) * len(b["held"]) for b in blocks)


def test_shards_add_up_in_their_order_by_parts(spark):
    rng = np.random.default_rng(4)
    values = rng.normal(size=(40, 7)) * 10.0 ** rng.integers(-9, 9, size=(40, 7))
    parts = [(s, k, [float(v) for v in values[s, at:at + 3]]) for s in range(40) for k, at in enumerate((0, 3, 6))]
    frame = spark.createDataFrame(parts[::-1], "shard int, part int, values array<double>").repartition(5)
    total, most = network._summed(frame)
    want = np.zeros(7)
    for row in values:
        want = want + row
    assert (total == want).all() and (most == values.max(0)).all()
    assert [len(x) for x in network._summed(frame.where("shard < 0"))] == [0, 0]


def test_clean_signal_keeps_what_the_detectors_read(spark, tmp_path):
    spark.sql("""select id as l_orderkey, id as l_partkey, id as l_suppkey, 1 as l_linenumber, id + 1.5d as l_quantity,
      id * 10d as l_extendedprice, if(id % 5 = 0, 0d, 0.1d) as l_discount, if(id % 7 = 0, 0d, 0.02d * id) as l_tax,
      element_at(array('N', 'A', 'R'), cast(id % 3 as int) + 1) as l_returnflag, timestamp'2020-01-01 00:00:00' as l_shipdate
      from range(60)""").write.parquet(str(tmp_path / "lineitem.parquet"))
    frame = _clean_signal(spark, str(tmp_path))
    assert frame.columns == [*FLOW_KEYS, *FOUR, "label"] and frame.count() == 60
    assert frame.where(" or ".join(f"{f} is null or abs({f}) = double('inf')" for f in FOUR)).count() == 0
    frame.unpersist()


def test_autoencoder_learns_and_ignores_layout(spark, cloud, tmp_path):
    def fit(n, **more):
        return Autoencoder(FEATURES, ["id"], encoder=(8, 2), decoder=(2, 8), activation="tanh", dropout=0.0, epochs=6,
                           batch_size=32, learning_rate=0.01, shards=2, **more).fit(benign(cloud).repartition(n))

    first = fit(1, checkpoint_path=str(tmp_path / "ckpt"), checkpoint_every=3)
    second = fit(7)
    assert np.allclose(first.theta, second.theta, atol=1e-9)
    history = first.history_frame(spark).orderBy("epoch").collect()
    assert len(history) == 6 and history[-1]["val_loss"] < 0.5 * history[0]["loss"]
    got = shares(cloud, first)
    assert abs(got["BENIGN"] - 0.05) < 0.01 and got["DoS"] > 0.9
    assert {r["epoch"] for r in spark.read.parquet(str(tmp_path / "ckpt")).collect()} == {3, 6}


def test_vae_scores_are_repeatable(cloud):
    model = VariationalAutoencoder(FEATURES, ["id"], latent=2, encoder=(8,), epochs=4, batch_size=64).fit(benign(cloud))
    got = shares(cloud, model)
    assert abs(got["BENIGN"] - 0.05) < 0.01 and got["DoS"] > 0.9
    first = {r["id"]: r["raw_score"] for r in model.transform(cloud).collect()}
    assert first == {r["id"]: r["raw_score"] for r in model.transform(cloud.repartition(3)).collect()}
    x = np.random.default_rng(1).normal(size=(5, 3))
    gradient, score = model.error_gradient()(x), model.matrix_score()
    for i in range(3):
        step = np.zeros(3)
        step[i] = 1e-5
        assert np.allclose(gradient[:, i], (score(x + step) - score(x - step)) / 2e-5, atol=1e-4)


def test_save_load_and_registry(spark, cloud, tmp_path):
    model = OneClassSVM(FEATURES, nu=0.2, max_iter=3, n_components=32).fit(benign(cloud))
    model.save(spark, str(tmp_path / "svm"))
    names = {"forest": str(tmp_path / "none"), "svm": str(tmp_path / "svm")}
    models = registry.ModelRegistry(spark, names)
    assert models.default == "svm" and models.status["forest"].startswith("missing")
    with pytest.raises(ValueError, match="available: svm"):
        models.get("forest")
    a = {r["id"]: r["raw_score"] for r in model.transform(cloud).collect()}
    scored = models.score_with(cloud)
    assert {r["id"]: r["raw_score"] for r in scored.collect()} == a
    assert scored.where("confidence > 1 or confidence < 0").count() == 0
    assert models.get().info(spark).first()["n_features"] == 3


# ---- explanations --------------------------------------------------------------------------------------------------

def shapley(score, x, background):
    """Contributions by their definition, over all orders of the features."""
    d = len(x)

    def value(known):
        mixed = background.copy()
        mixed[:, list(known)] = x[list(known)]
        return score(mixed).mean()

    phi = np.zeros(d)
    for i in range(d):
        others = [j for j in range(d) if j != i]
        for size in range(d):
            for known in itertools.combinations(others, size):
                weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
                phi[i] += weight * (value((*known, i)) - value(known))
    return phi


def crooked(rows):
    return rows[:, 0] * rows[:, 1] + np.sin(rows[:, 2]) + np.maximum(rows[:, 3], rows[:, 0])


def test_kernel_contributions_equal_shapley_values():
    rng = np.random.default_rng(2)
    background, rows = rng.normal(size=(7, 4)), rng.normal(size=(5, 4))
    got = explain.kernel_contributions(crooked, background)(rows)
    for x, phi in zip(rows, got):
        assert np.allclose(phi, shapley(crooked, x, background), atol=1e-8)


def test_sampled_coalitions_are_additive_and_exact_for_linear_scores():
    rng = np.random.default_rng(4)
    w = rng.normal(size=14)
    background, rows = rng.normal(size=(6, 14)), rng.normal(size=(3, 14))
    got = explain.kernel_contributions(lambda r: r @ w, background, nsamples=400)(rows)
    assert np.allclose(got, w * (rows - background.mean(0)), atol=1e-6)
    assert np.allclose(got.sum(1), rows @ w - (background @ w).mean())


def test_tree_contributions_are_additive_and_match_the_definition(cloud):
    model = IsolationForest(FEATURES, ["id"], n_trees=3, max_samples=16).fit(cloud)
    contributions, base = explain.tree_contributions(model)
    rows = np.random.default_rng(6).normal(size=(4, 3))
    got = contributions(rows)
    assert np.allclose(got.sum(1) + base, model.path_length()(rows))
    table = model.table

    def known_value(x, known, tree, node=0):
        i = np.flatnonzero((table["tree"] == tree) & (table["node"] == node))[0]
        f = table["feature"][i]
        if f < 0:
            return float(table["depth"][i] + average_path(table["size"][i]))
        if f in known:
            return known_value(x, known, tree, table["left"][i] if x[f] <= table["threshold"][i] else table["right"][i])
        size = {n: table["size"][np.flatnonzero((table["tree"] == tree) & (table["node"] == n))[0]]
                for n in (table["left"][i], table["right"][i])}
        return sum(known_value(x, known, tree, n) * s for n, s in size.items()) / table["size"][i]

    def value(x, known):
        return np.mean([known_value(x, known, t) for t in range(3)])

    x = rows[0]
    for i in range(3):
        others = [j for j in range(3) if j != i]
        phi = sum(math.factorial(len(k)) * math.factorial(2 - len(k)) / 6 * (value(x, (*k, i)) - value(x, k))
                  for s in range(3) for k in itertools.combinations(others, s))
        assert got[0, i] == pytest.approx(phi, abs=1e-9)


def test_resumed_training_equals_the_uninterrupted_one(spark, cloud, tmp_path):
    rows = keep(benign(cloud))
    plan = {"encoder": (4, 2), "decoder": (4,), "shards": 3, "batch_size": 64, "halve_after": 1, "patience": 6,
            "learning_rate": 0.6, "checkpoint_every": 3}

    def fit(epochs, **more):
        return Autoencoder(FEATURES, ["id"], epochs=epochs, **plan, **more).fit(rows)

    path = str(tmp_path / "snapshots")
    whole = fit(9)
    fit(4, checkpoint_path=path)  # ends after its snapshot of epoch 3
    resumed = fit(9, checkpoint_path=path)
    assert resumed.history == whole.history and len({rate for *_, rate in whole.history}) > 1
    assert np.array_equal(resumed.theta, whole.theta) and resumed.threshold == whole.threshold
    with pytest.raises(ValueError, match="other settings"):
        fit(9, checkpoint_path=path, seed=7)


def test_given_validation_rows(spark, cloud):
    other = cloud.where("label = 'DoS'")
    for estimator in (Autoencoder, VariationalAutoencoder):
        sizes = {"encoder": (4, 2), "decoder": (4,)} if estimator is Autoencoder else {"latent": 2, "encoder": (4,)}
        model = estimator(FEATURES, ["id"], epochs=2, **sizes).fit(benign(cloud), other)
        held = estimator(FEATURES, ["id"], epochs=2, **sizes).fit(benign(cloud))
        assert model.history[-1][2] > 3 * held.history[-1][2]  # attacks are rebuilt badly


def test_tree_contributions_of_tables_and_paths_agree(spark, monkeypatch):
    """Both forms equal the definition over all subsets, also where a feature splits a path again."""
    from flowlens.detect import forest

    rng = np.random.default_rng(8)
    for d in (1, 3, 6):
        points = rng.normal(size=(64, d))
        nodes = pd.concat([forest.grow_tree(points, t, 1, np.arange(d), 6) for t in range(4)], ignore_index=True)
        model = forest.IsolationForestModel.from_nodes(spark.createDataFrame(nodes), [f"f{i}" for i in range(d)], 64)
        rows = rng.normal(size=(50, d))
        tables, base = explain.tree_contributions(model)
        got = tables(rows)
        monkeypatch.setattr(explain, "MAX_TABLE", 0)
        paths, same = explain.tree_contributions(model)
        monkeypatch.undo()
        assert same == base and np.allclose(paths(rows), got, atol=1e-10)
        assert np.allclose(base + got.sum(axis=1), model.path_length()(rows), atol=1e-9)
        value = model.table["depth"] + average_path(model.table["size"])

        def expected(x, known):
            def below(tree, n):
                at = model.table["node"][tree].tolist().index(n)
                i = int(np.flatnonzero(tree)[at])
                f = int(model.table["feature"][i])
                if f < 0:
                    return value[i]
                children = [int(model.table[side][i]) for side in ("left", "right")]
                if f in known:
                    return below(tree, children[0 if x[f] <= model.table["threshold"][i] else 1])
                sizes = [model.table["size"][tree][model.table["node"][tree].tolist().index(c)] for c in children]
                return sum(s * below(tree, c) for s, c in zip(sizes, children)) / sum(sizes)

            return np.mean([below(model.table["tree"] == t, 0) for t in range(4)])

        if d == 3:
            for x, phi in zip(rows[:5], got):
                for j in range(d):
                    rest = [k for k in range(d) if k != j]
                    want = sum(math.factorial(len(s)) * math.factorial(d - 1 - len(s)) / math.factorial(d)
                               * (expected(x, {*s, j}) - expected(x, set(s)))
                               for n in range(d) for s in itertools.combinations(rest, n))
                    assert phi[j] == pytest.approx(want, abs=1e-9)


def test_gradient_contributions_are_complete():
    rng = np.random.default_rng(8)
    layers = [network.Dense(3, 2, "tanh"), network.Dense(2, 3, "linear", False)]
    model = AutoencoderModel.from_weights(layers, network.initial(layers, rng), FEATURES)
    background, rows = rng.normal(size=(6, 3)), rng.normal(size=(4, 3))
    got = explain.gradient_contributions(model.error_gradient(), background)(rows)
    score = model.matrix_score()
    assert np.allclose(got.sum(1), score(rows) - score(background).mean(), atol=1e-6)


def test_top_features_break_ties_by_order(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, [0.5, -2.0, 2.0])], "a double, b double, c double, shap array<double>")
    top = df.select(explain.top_features(FEATURES, F.col("shap"), 2).alias("t")).first()["t"]
    assert [(t["feature"], t["shap_value"], t["feature_value"]) for t in top] == [("b", -2.0, 2.0), ("c", 2.0, 3.0)]
    wide = explain.explain_batch(df, FEATURES, 5).first().asDict()
    assert wide["top_3_feature"] == "a" and "top_4_feature" not in wide


def test_vae_given_weights_without_hidden_layers():
    parts = {"encoder": [], "mu": [network.Dense(2, 1, "linear")], "log_var": [network.Dense(2, 1, "linear")],
             "decoder": [network.Dense(1, 2, "linear", False)]}
    model = VariationalAutoencoderModel.from_weights(parts, np.array([1.0, 0, 0, 0, 0, 0, 1.0, 0, 0, 0]), ["a", "b"],
                                                     None, 0.5)
    assert model.matrix_score()(np.array([[2.0, 0.0]]))[0] == pytest.approx(0.5 * 0.5 * 4.0)


def test_half_of_all_rows_are_copies(spark):
    df = spark.range(60_000).select(F.when(F.col("id") < 30_000, 0).otherwise(F.col("id")).alias("k")).select(
        "k", *[(F.pmod(F.xxhash64("k", F.lit(i)), F.lit(1000)) / 1000.0).alias(f) for i, f in enumerate("ab")])
    copy = df.where("k = 0").first()
    forest = IsolationForest(["a", "b"], ["k"], n_trees=10, max_samples=64, contamination="auto").fit(df)
    roots = forest.table["size"][forest.table["node"] == 0]
    assert len(roots) == 10 and set(roots) == {64}
    # equal rows end in one leaf: its size is the number of copies in a root
    largest = [max(forest.table["size"][(forest.table["tree"] == t) & (forest.table["feature"] < 0)]) for t in range(10)]
    assert copy["k"] == 0 and 22 <= np.mean(largest) <= 42


def test_pooled_gamma_skips_missing_entries(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, None), (4.0, 30.0), (None, 50.0)], "a double, b double")
    entries = np.array([1, 2, 4, 10, 30, 50])
    assert pooled_gamma(df, ["a", "b"]) == pytest.approx(1 / (2 * entries.var()))


def test_models_refuse_frames_without_their_features(spark, cloud):
    model = OneClassSVM(FEATURES, nu=1.0).fit(benign(cloud))
    for estimator in (OneClassSVM(FEATURES), IsolationForest(FEATURES, ["id"]), Autoencoder(FEATURES, ["id"]),
                      VariationalAutoencoder(FEATURES, ["id"])):
        with pytest.raises(ValueError, match="expected 3 features, 2 present"):
            estimator.fit(cloud.drop("b"))
    with pytest.raises(ValueError, match="missing .'b'."):
        model.transform(cloud.drop("b"))
    with pytest.raises(ValueError, match="expected 3 features"):
        registry.score_flows(cloud.drop("b"), model)
    aligned = registry.score_flows(cloud.drop("b"), model, strict=False)
    assert "b" not in aligned.columns
    zero = {r.id: r.raw_score for r in model.transform(cloud.withColumn("b", F.lit(0.0))).collect()}
    assert {r.id: r.raw_score for r in aligned.collect()} == zero


def test_a_user_function_is_a_detector(spark, cloud):
    plain = UserModel(lambda rows: rows["a"] - 2 * rows["b"], FEATURES, threshold=5.0)
    signed = UserModel(lambda rows: 5.0 - rows["a"] + 2 * rows["b"], FEATURES, decision=True)
    a, b = ({r.id: (r.prediction, r.anomaly_probability) for r in m.transform(cloud).collect()} for m in (plain, signed))
    assert all(a[i][0] == b[i][0] and a[i][1] == pytest.approx(b[i][1]) for i in a) and 0 < sum(p for p, _ in a.values()) < 1600
    importance = {r.feature: r.importance for r in ocsvm.permutation_importance(cloud, plain, ["id"]).collect()}
    assert importance["c"] == 0 and importance["b"] > 0
    scored = registry.score_with(cloud, signed, "mine").first()
    assert scored.model == "mine" and 0 <= scored.confidence <= 1
    with pytest.raises(TypeError):
        plain.save(spark, "nowhere")


def test_linear_models_take_the_closed_form(spark, cloud):
    model = OneClassSVM(FEATURES, nu=0.3, kernel="linear").fit(benign(cloud))
    some = cloud.limit(40)
    closed = explain.explain_model(some, model, benign(cloud), ["id"], 20)
    assert "ArrowEvalPython" not in closed._jdf.queryExecution().optimizedPlan().toString()
    slow = explain.explain_model(some, model, benign(cloud), ["id"], 20, method="kernel")
    by_id = {r.id: r for r in slow.collect()}
    for r in closed.collect():
        assert r.shap == pytest.approx(by_id[r.id].shap, abs=1e-9)
        assert r.expected_value == pytest.approx(by_id[r.id].expected_value)
    masks, _ = explain.coalitions(9, 100, 1)
    assert len(masks) == 100 and len(explain.coalitions(9, None, 1)[0]) == 510 and len(explain.coalitions(5, 100, 1)[0]) == 30


def test_shares_of_many_atoms_take_few_steps():
    from flowlens.detect.svm_solver import shares_of

    atoms = np.random.default_rng(3).normal(size=(60, 20))
    shares = shares_of(atoms, np.ones(60) / 60, 1e-8, 1e-14, steps=200)
    w = shares @ atoms    # the hull holds the origin
    assert np.isclose(shares.sum(), 1.0) and (shares >= 0).all() and float(w @ w) < 1e-12


def test_svm_of_a_small_nu_needs_few_rounds(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(24_000, 2)), rng.uniform(-6, 6, size=(1_000, 2))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"])).repartition(4)
    model = OneClassSVM(["a", "b"], nu=0.002).fit(df)
    assert model.rounds <= 25 and model.gap <= 1e-3 * float(model.weights @ model.weights)


def test_tree_contributions_by_subsets_equal_those_by_leaves(monkeypatch):
    from types import SimpleNamespace

    from flowlens.detect.forest import grow_tree
    from flowlens.operators import explain

    rng = np.random.default_rng(1)
    x = np.c_[rng.integers(1, 9, 600), rng.normal(size=600), rng.gamma(1.0, 10.0, 600)]
    nodes = pd.concat([grow_tree(x[t::10], t, 42, np.arange(3), 6) for t in range(10)]).reset_index(drop=True)
    model = SimpleNamespace(table={c: nodes[c].to_numpy() for c in nodes.columns}, features=["a", "b", "c"])
    made = []
    grids = explain._Grids.__call__
    monkeypatch.setattr(explain._Grids, "__call__", lambda self, rows: made.append(1) or grids(self, rows))
    by_subsets, base = explain.tree_contributions(model)
    monkeypatch.setattr(explain, "GRID_FEATURES", ())
    by_leaves, same = explain.tree_contributions(model)
    assert base == same and np.allclose(by_subsets(x), by_leaves(x), atol=1e-12) and made


def test_range_partitions_grow_with_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from flowlens.operators import ordering

    monkeypatch.setattr(ordering, "SMALL", 50)
    df = spark.range(1_000).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"))
    parts = ordering.ordered_parts(df, [F.col("v").asc()], 1_000)
    assert parts.groupBy(ordering.PART).count().count() > 15
    sums = ordering.running_sums(df, [F.col("v").asc()], {"upto": "v"}, ["g"], {"all": "v"})
    totals = {0: sum(range(0, 1_000, 2)), 1: sum(range(1, 1_000, 2))}
    assert all(r["all"] == totals[r["g"]] and r["upto"] == sum(range(r["g"], r["v"] + 1, 2)) for r in sums.collect())


def test_previous_rows_across_partitions(spark, monkeypatch):
    from flowlens.operators import ordering

    rows = [(i // 2, None if i % 5 == 0 else float(i)) for i in range(100)]   # keys repeat, values may be missing
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    expected = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0.0))
    expected = sorted(((k, v, expected[i - 1][1]) for i, (k, v) in enumerate(expected)), key=str)
    for small in (1_000, 10):
        monkeypatch.setattr(ordering, "SMALL", small)
        found = ordering.with_previous(df, ["k"], ["v"], "before_")
        assert sorted((tuple(r) for r in found.collect()), key=str) == expected
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


def test_feature_maps_work_in_blocks(monkeypatch):
    from flowlens.detect import svm_solver

    seen = []
    monkeypatch.setattr(svm_solver, "BLOCK", 1_000)
    run = svm_solver.in_blocks(lambda rows: seen.append(len(rows)) or rows.sum(axis=1), 100)
    assert np.allclose(run(np.ones((35, 2))), 2.0) and max(seen) == 10 and len(run(np.ones((0, 2)))) == 0


def test_gradients_summed_along_lines_are_those_of_single_points():
    rng = np.random.default_rng(4)
    for act, last in (("relu", "linear"), ("tanh", "sigmoid"), ("sigmoid", "relu")):
        layers = Autoencoder(list("abcde"), [], encoder=(7, 3), decoder=(3, 7), activation=act, output_activation=last).layers()
        gradient = AutoencoderModel.from_weights(layers, network.initial(layers, rng) + 0.1, list("abcde")).error_gradient()
        background, rows = rng.normal(size=(20, 5)), rng.normal(size=(400, 5))
        single = explain.gradient_contributions(lambda x: gradient(x), background)(rows)
        assert gradient.along(rows.T, rows.T, np.array([0.5]), np.array([1.0])).shape == (5, 400)
        assert np.allclose(explain.gradient_contributions(gradient, background)(rows), single, rtol=1e-10, atol=1e-13)


def test_points_of_shared_directions(spark):
    """Several cuts of one direction, several jobs of one map, all rows: each against a plain sum."""
    from flowlens.detect import svm_solver

    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").repartition(5)
    maps = [FeatureMap("rbf", 3, 0.3, 16, 3, 0.0, 1), FeatureMap("linear", 3, 1.0, 16, 3, 0.0, 1)]
    first, second = rng.normal(size=(16, 2)), rng.normal(size=(3, 1))
    cuts, column = np.array([-0.5, 0.0, 0.4]), np.array([0, 1, 1])
    jobs = [(0, first, cuts, column), (1, second, np.array([0.2])), (0, None, None), (0, first, np.array([0.1, -9.0]))]
    got = svm_solver.sums(df.select(F.struct("a", "b", "c").alias("x")), maps, jobs)
    z = [m(x) for m in maps]
    for (i, directions, cuts, *which), lines in zip(jobs, got):
        if directions is None:
            below = np.ones((500, 1))
        else:
            below = (z[i] @ directions)[:, which[0] if which else np.arange(len(cuts))] <= cuts
        assert np.allclose(lines, np.hstack([below.T @ z[i], below.sum(axis=0)[:, None]]), atol=1e-9)


class Enough(Exception):
    """Ends a fit once its sample is known."""


def test_one_gamma_is_one_map_and_repeats_thin_no_sample(spark, monkeypatch):
    """Rules that give one gamma share a map; every row eight times gives as large a sample as every row once."""
    from flowlens.detect import svm_solver

    monkeypatch.setattr(svm_solver, "START_ROWS", 400)
    monkeypatch.setattr(svm_solver, "REST_ROWS", 300)
    monkeypatch.setattr(svm_solver, "TAIL_ROWS", 300)
    calls, solved = [], svm_solver._solved

    def spied(sample, problems, *others):
        calls.append(problems)
        if len(calls) < 2:
            return solved(sample, problems, *others)
        counts.append(sample.where("problem = 0").select(*FEATURES).distinct().count())
        raise Enough

    monkeypatch.setattr(svm_solver, "_solved", spied)
    rng = np.random.default_rng(6)
    rows = [tuple(map(float, r)) for r in rng.normal(size=(2500, 3)) ** 3]
    counts = []
    for copies in (1, 8):
        calls.clear()
        df = spark.createDataFrame(rows * copies, "a double, b double, c double").repartition(4)
        with pytest.raises(Enough):
            fit_all(df, [OneClassSVM(FEATURES, nu=0.02, gamma=g, n_components=32) for g in ("scale", "auto")])
        assert calls[0][0].fmap is calls[0][1].fmap
    assert counts[1] > 0.7 * counts[0]
