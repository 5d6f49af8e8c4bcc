"""Edge rules of scans, cleaning, labels, scaling and sampling."""

import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowlens.functions.numeric import long_form, nan_to_num
from flowlens.operators import clean, labels, metrics, quantiles, sampling, schema
from flowlens.operators.clean import FlowCleaner
from flowlens.operators.quantiles import exact_percentiles, grouped_percentiles, with_percentiles
from flowlens.operators.scale import FlowScaler, FlowScalerModel
from flowlens.plans.preprocess import load_and_clean, preprocess, profile_report
from flowlens.sources import samples, synthetic
from flowlens.sources.flows import read_days, read_flows
from flowlens.spec import RAW_FEATURES, alias_table, request_fields, snake_name, to_snake

INF, NAN = float("inf"), float("nan")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---- names and files -----------------------------------------------------------------------------------------------

def test_aliases_and_request_fields():
    assert snake_name(" Flow Bytes/s") == "flow_bytes_per_sec"
    assert snake_name(" Total Backward Packets") == "total_bwd_packets"
    assert snake_name(" Down/Up Ratio") == "down_up_ratio"
    assert len(RAW_FEATURES) == 80 and len(alias_table()) == 80
    assert len(request_fields()) == 74


def test_sample_flows_keep_their_rate(spark):
    df = to_snake(samples.sample_flows(spark))
    check = df.select(F.abs(F.col("flow_bytes_per_sec") - (F.col("total_length_fwd_packets") + F.col(
        "total_length_bwd_packets")) / (F.col("flow_duration") / 1e6)).alias("d")).collect()
    assert len(check) == 2 and all(r["d"] < 1e-3 for r in check)


def test_read_flows_numbers_headers_and_encoding(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    header = " Flow Duration, Fwd Header Length, Fwd Header Length, Label\n"
    good.write_bytes((header + "1,inf,2,BENIGN\n-inf,nan,x,Web Attack – XSS\n").encode("utf-8"))
    bad.write_bytes((header + "7,8,9,Web Attack \x96 XSS\n").encode("latin-1"))
    df = read_flows(spark, [str(good), str(bad)])
    assert df.columns == ["Flow Duration", "Fwd Header Length", "Fwd Header Length_1", "Label", "_rescued"]
    assert [r[0] for r in df.select("_rescued").where("_rescued is not null").collect()] == [{"Fwd Header Length_1": "x"}]
    got = rows(df.drop("_rescued"))
    assert (1.0, INF, 2.0, "BENIGN") in got
    assert (7.0, 8.0, 9.0, "Web Attack - XSS") in got
    other = [r for r in got if r[0] == -INF][0]
    assert math.isnan(other[1]) and other[2] is None and other[3] == "Web Attack - XSS"


def test_read_flows_by_each_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Proto,x,y,Label\nTCP,1,2,BENIGN\n,3,4,BENIGN\n")
    (tmp_path / "b.csv").write_text("Proto,y,x,Label\nUDP,20,10,DoS\n")
    (tmp_path / "c.csv").write_text("Proto,x,Label\n,7,DoS\n")
    df = read_flows(spark, str(tmp_path))
    assert dict(df.dtypes)["Proto"] == "string" and dict(df.dtypes)["x"] == "double"
    got = {(r["Proto"], r["x"], r["y"], r["Label"]) for r in df.collect()}
    assert got == {("TCP", 1.0, 2.0, "BENIGN"), (None, 3.0, 4.0, "BENIGN"), ("UDP", 10.0, 20.0, "DoS"),
                   (None, 7.0, None, "DoS")}


def test_mixed_columns_lose_nothing(spark, tmp_path):
    lines = ["Proto,Kind,x,Label"] + [f"{'TCP' if i % 5 < 2 else i},k{i},{i},BENIGN" for i in range(50)] + [" , ,-7,DoS"]
    (tmp_path / "a.csv").write_text("\n".join(lines + lines[1:3]))
    df = read_flows(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"Proto": "double", "Kind": "string", "x": "double", "Label": "string",
                               "_rescued": "map<string,string>"}
    got = {r.x: (r.Proto, r._rescued) for r in df.collect()}
    assert all(got[i] == ((None, {"Proto": "TCP"}) if i % 5 < 2 else (i, None)) for i in range(50))
    assert df.count() == 53 and clean.distinct_rows(df).count() == 51
    cleaned = FlowCleaner(["x"], label="Label", remove_constant=False).fit(df).transform(df.drop("Proto"))
    assert cleaned.where("_rescued.Proto = 'TCP'").count() == 20
    prepared = preprocess(df.drop("Proto", "Kind"), label="Label", scaler=None)
    assert prepared.features == ["x"] and prepared.train.where("_rescued is not null").count() > 0


def test_a_file_of_numbers_is_read_without_looking_for_other_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Key,x,y,Label\nk1,1,inf,BENIGN\nk2, ,nan,DoS\n")
    df = read_flows(spark, str(tmp_path / "a.csv"), text=["Key"])
    assert dict(df.dtypes) == {"Key": "string", "x": "double", "y": "double", "Label": "string", "_rescued": "map<string,string>"}
    assert {(r.Key, r.x, r._rescued) for r in df.collect()} == {("k1", 1.0, None), ("k2", None, None)}
    assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    (tmp_path / "b.csv").write_text("Key,x,y,Label\nk3,n/a,-7,BENIGN\n")
    both = read_flows(spark, str(tmp_path), text=["Key"])
    assert {(r.Key, r.x, str(r._rescued)) for r in both.collect()} == {
        ("k1", 1.0, "None"), ("k2", None, "None"), ("k3", None, "{'x': 'n/a'}")}


def test_read_flows_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_flows(spark, str(tmp_path / "none.csv"))


def test_read_days_tags_rows(spark, tmp_path):
    for name in ("a.csv", "b.csv"):
        (tmp_path / name).write_text(" x, Label\n1,BENIGN\n")
    df = read_days(spark, str(tmp_path), {"one": ("a.csv", "BENIGN"), "two": ("b.csv", "DDoS")})
    assert rows(df.select("day", "attack_category", "x")) == [("one", "BENIGN", 1.0), ("two", "DDoS", 1.0)]


def test_load_and_clean(spark, tmp_path):
    (tmp_path / "f.csv").write_text("Flow ID, a, b, Label\nq,1,5,BENIGN\nq,1,5,BENIGN\nr,inf,5,x\ns,3,5,x\n")
    df = load_and_clean(spark, str(tmp_path / "f.csv"))
    assert df.columns == ["a", "Label", "_rescued"]
    assert rows(df) == [(1.0, "BENIGN", None), (3.0, "x", None), (3.0, "x", None)]


# ---- generator -----------------------------------------------------------------------------------------------------

def test_synthetic_flows_have_the_stated_defects(spark):
    df = synthetic.synthetic_flows(spark, 3000, seed=7)
    assert len(df.columns) == 72
    c = df.agg(F.count("*").alias("n"), F.count_if(F.col("`Flow Bytes/s`") == INF).alias("b"),
               F.count_if(F.col("`Flow Packets/s`") == INF).alias("p"),
               F.count_if(F.col("`Fwd IAT Mean`").isNull()).alias("m"),
               F.avg("Flow Duration").alias("mean"), F.avg("Total Fwd Packets").alias("packets")).first()
    assert c["n"] == 3100
    assert 50 <= c["b"] <= 150 and 25 <= c["p"] <= 125 and 30 <= c["m"] <= 130
    assert abs(c["mean"] - 5000) < 400 and abs(c["packets"] - 10) < 0.3
    base = df.limit(3000)
    assert base.count() == 3000
    assert df.count() - df.distinct().count() == 100
    again = synthetic.synthetic_flows(spark.newSession(), 3000, seed=7).repartition(3)
    assert again.exceptAll(df).count() == 0


# ---- cleaning ------------------------------------------------------------------------------------------------------

def frame(spark, data):
    return spark.createDataFrame(data, "a double, b double, label string")


def test_infinite_then_missing_then_constant(spark):
    df = frame(spark, [(1.0, 5.0, "x"), (INF, 5.0, "x"), (-INF, None, "y"), (3.0, 5.0, "y"), (NAN, 5.0, "z")])
    out = FlowCleaner(["a", "b"], handle_nan="mean").fit(df).transform(df)
    assert out.columns == ["a", "label"]
    assert sorted(r["a"] for r in out.collect()) == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_all_missing_column_stays_and_all_infinite_becomes_missing(spark):
    df = frame(spark, [(None, INF, "x"), (NAN, INF, "y")])
    model = FlowCleaner(["a", "b"], handle_nan="ignore").fit(df)
    assert model.constant_features == []
    assert rows(model.transform(df).select("a", "b")) == [(None, None), (None, None)]


def test_drop_missing_also_drops_missing_labels_only_when_a_feature_is_missing(spark):
    clean_features = frame(spark, [(1.0, 2.0, None), (2.0, 3.0, "x")])
    assert FlowCleaner(["a", "b"]).fit(clean_features).transform(clean_features).count() == 2
    one_missing = frame(spark, [(1.0, 2.0, None), (2.0, 3.0, "x"), (None, 4.0, "x"), (5.0, 6.0, "x")])
    assert FlowCleaner(["a", "b"]).fit(one_missing).transform(one_missing).count() == 2


@pytest.mark.parametrize("options", [{}, {"inf_replacement": 2.0}, {"handle_inf": "ignore"}, {"handle_inf": "drop"}])
def test_constants_of_complete_rows_come_from_the_pass_of_the_statistics(spark, monkeypatch, options):
    passes = []
    monkeypatch.setattr(clean, "long_form", lambda *given: passes.append(given) or long_form(*given))
    rng = np.random.default_rng(17)
    found = set()
    for _ in range(5):
        values = [1.0, 2.0, 2.0, 2.0, INF, -INF, NAN, None]
        data = [(2.0, None, "x")] + [(values[i], values[j], "x" if k else None) for i, j, k in rng.integers(0, [8, 8, 4], (5, 3))]
        used = [r for r in data if options.get("handle_inf") != "drop" or not {INF, -INF} & {*r[:2]}]
        finite = [[r[j] for r in used if r[j] is not None and math.isfinite(r[j])] for j in (0, 1)]

        def put(x, j):
            if x is None or math.isnan(x):
                return None
            if math.isfinite(x) or "handle_inf" in options:
                return x
            return options.get("inf_replacement", (max if x > 0 else min)(finite[j], default=None))

        complete = [r for r in ((put(r[0], 0), put(r[1], 1), r[2]) for r in used) if None not in r]
        want = [f for j, f in enumerate("ab") if len({r[j] for r in complete}) == 1]
        df = frame(spark, data)
        passes.clear()
        assert FlowCleaner(["a", "b"], **options).fit(df).constant_features == want
        found.update(want)
        unknown = not options and any(not finite[j] and {INF, -INF} & {r[j] for r in used} for j in (0, 1))
        assert len(passes) == (2 if unknown else 1)
    assert found


def test_zero_fill_can_make_a_constant_column_vary(spark):
    df = frame(spark, [(7.0, 1.0, "x"), (None, 2.0, "x")])
    assert FlowCleaner(["a", "b"], handle_nan="zero").fit(df).constant_features == []
    assert FlowCleaner(["a", "b"], handle_nan="drop").fit(df).constant_features == ["a", "b"]
    assert FlowCleaner(["a", "b"], handle_nan="median").fit(df).constant_features == ["a"]


def test_duplicates_with_missing_values_are_equal(spark):
    df = frame(spark, [(NAN, -0.0, "x"), (NAN, 0.0, "x"), (1.0, 1.0, "x")])
    model = FlowCleaner(["a", "b"], handle_nan="ignore").fit(df)
    assert model.transform(df).count() == 2
    report = model.report(df).first()
    assert report["duplicates_removed"] == 1 and report["initial_rows"] == 3


def test_median_follows_replaced_infinities_and_ignores_duplicates(spark):
    df = frame(spark, [(1.0, 0.0, "x"), (2.0, 0.0, "x"), (INF, 0.0, "x"), (None, 1.0, "x"), (1.0, 0.0, "x")])
    out = FlowCleaner(["a", "b"], handle_nan="median").fit(df).transform(df)
    assert sorted(r["a"] for r in out.collect()) == [1.0, 2.0, 2.0, 2.0]


def test_clamp_uses_zero_for_an_all_missing_column(spark):
    df = frame(spark, [(None, -INF, "x"), (None, 1.0, "x")])
    got = rows(clean.clamp_and_fill_median(df, ["a", "b"]).select("a", "b"))
    assert got == [(0.0, 1.0), (0.0, 1.7976931348623157e308)]


def test_model_applies_to_new_data(spark):
    train = frame(spark, [(1.0, 1.0, "x"), (9.0, 2.0, "x"), (INF, 3.0, "x")])
    model = FlowCleaner(["a", "b"], handle_nan="mean").fit(train)
    assert rows(model.transform(frame(spark, [(INF, 1.0, "q"), (100.0, 2.0, "q")])).select("a")) == [(100.0,), (9.0,)]


def test_empty_input(spark):
    df = frame(spark, [])
    assert FlowCleaner(["a", "b"], handle_nan="median").fit(df).transform(df).count() == 0
    assert exact_percentiles(df, ["a"], [0.5]) == {("a", 0.5): None}


def test_nan_to_num(spark):
    df = spark.createDataFrame([(NAN,), (INF,), (-INF,), (None,), (2.0,)], "x double")
    assert [r[0] for r in df.select(nan_to_num(F.col("x"))).collect()] == [0.0, 1e10, -1e10, 0.0, 2.0]


# ---- schema --------------------------------------------------------------------------------------------------------

def test_alignment_and_count_checks(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0)], "a double, b double, c double")
    assert rows(schema.align_by_position(df, ["x", "y"])) == [(1.0, 2.0)]
    assert rows(schema.align_by_position(df, ["x", "y", "z", "w"])) == [(1.0, 2.0, 3.0, 0.0)]
    assert rows(schema.align_by_name(df, ["c", "nope"])) == [(3.0, 0.0)]
    with pytest.raises(ValueError, match="expected 2 features"):
        schema.check_feature_count(df, ["a", "nope"])


def test_validation_rules_and_defaults(spark):
    df = spark.createDataFrame([(None, 1.5, -1.0, None)], "a double, b double, c double, d double")
    out = schema.validate_rows(df, {"d": 0.0}, required=["a", "d"], integers=["b"], non_negative=["c"]).first()
    assert [tuple(x) for x in out["failed_rules"]] == [("a", "required"), ("b", "integer"), ("c", "non_negative")]
    assert out["d"] == 0.0


def test_assert_finite(spark):
    df = spark.createDataFrame([(1.0,), (NAN,)], "a double")
    with pytest.raises(Exception, match="missing or infinite"):
        schema.assert_finite(df, ["a"]).collect()
    assert schema.assert_finite(df.where("not isnan(a)"), ["a"]).count() == 1
    assert schema.violations(df, ["a"]).first()[0] == 1


# ---- labels and scaling --------------------------------------------------------------------------------------------

def test_missing_label_is_an_attack_and_never_contains(spark):
    df = spark.createDataFrame([("BENIGN",), (None,), ("DoS Hulk",)], "label string")
    out = {r["label_original"]: r["label"] for r in labels.encode_binary(df).collect()}
    assert out == {"BENIGN": 0, None: 1, "DoS Hulk": 1}
    assert schema.filter_label_contains(df, "DoS").count() == 1


def test_multiclass_codes_follow_text_order(spark):
    df = spark.createDataFrame([("b",), ("a",), ("B",)], "label string")
    out = {r["label_original"]: r["label"] for r in labels.encode_multiclass(df).collect()}
    assert out == {"B": 0, "a": 1, "b": 2}
    assert {tuple(r) for r in labels.label_mapping(df).collect()} == set(out.items())


def test_multiclass_keeps_missing_labels(spark):
    df = spark.range(12_000).select(F.format_string("%05d", "id").alias("label")).unionByName(
        spark.createDataFrame([(None,), (None,)], "label string"))
    out = labels.encode_multiclass(df)
    assert out.count() == 12_002 and out.where("label is null and label_original is null").count() == 2
    assert out.where("label <> int(label_original)").isEmpty()


def test_scaler_edge_cases(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    standard = FlowScaler(["a", "b"]).fit(df)
    assert rows(standard.transform(df)) == [(-1.0, 0.0), (1.0, 0.0)]
    assert rows(standard.inverse(standard.transform(df))) == rows(df)
    minmax = FlowScaler(["a", "b"], "minmax").fit(df)
    assert rows(minmax.transform(spark.createDataFrame([(5.0, 6.0)], "a double, b double"))) == [(2.0, 1.0)]
    again = FlowScalerModel.from_frame(standard.to_frame(spark))
    assert rows(again.transform(df)) == rows(standard.transform(df))


# ---- percentiles ---------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("limit", [200_000, 50])
def test_percentiles_match_numpy(spark, limit):
    rng = np.random.default_rng(1)
    spread = rng.normal(size=5000)
    tied = np.where(rng.random(5000) < 0.6, 7.0, rng.integers(0, 20, 5000).astype(float))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(spread, tied)], "a double, b double").repartition(5)
    wanted = [0.0, 0.01, 0.5, 0.999, 1.0]
    got = exact_percentiles(df, ["a", "b"], wanted, max_listed=limit)
    for p in wanted:
        assert got[("a", p)] == pytest.approx(np.quantile(spread, p), abs=1e-12)
        assert got[("b", p)] == pytest.approx(np.quantile(tied, p), abs=1e-12)



@pytest.mark.parametrize("groups_at_once", [10_000, 0])
def test_grouped_percentiles_match_numpy(spark, monkeypatch, groups_at_once):
    monkeypatch.setattr(quantiles, "MAX_GROUPS", groups_at_once)
    draw = np.random.default_rng(11)
    data = {"one": [5.0], "two": [1.0, 2.0], "same": [3.0] * 5000, None: list(draw.normal(size=70)),
            "hot": list(np.round(draw.lognormal(0, 2, 60_000), 3)), "few values": list(draw.integers(0, 4, 20_000).astype(float)),
            "ends": [-1e200] * 300 + list(draw.normal(size=20_000)) + [1e200] * 300}
    rows = [(g, float(x)) for g, values in data.items() for x in values]
    rows += [("missing", None), ("hot", None), ("two", float("nan"))]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["g", "x"]).sample(frac=1, random_state=1), "g string, x double")
    wanted = [0.5, 0.0, 1.0, 0.9, 0.25, 0.9999]
    got = {r.g: r.percentiles for r in grouped_percentiles(df, ["g"], "x", wanted).collect()}
    assert got.keys() == data.keys()
    for g, values in data.items():
        assert got[g] == pytest.approx(list(np.percentile(values, [100 * p for p in wanted])), rel=1e-12), g
    both = with_percentiles(df.groupBy("g").count(), ["g"], grouped_percentiles(df, ["g"], "x", [0.5]), "m")
    assert {r.g: r.m for r in both.collect()}["missing"] is None and both.count() == len(data) + 1
    assert grouped_percentiles(df.limit(0), ["g"], "x", [0.5]).collect() == []


def test_threshold_trials_without_benign_rows(spark):
    rows = [("a", 0, float(i)) for i in range(100)] + [("a", 1, 99.5), ("b", 1, 3.0), (None, 0, 1.0), (None, 1, 2.0), ("a", 1, None)]
    df = spark.createDataFrame(rows, "model string, label int, anomaly_score double")
    got = {(r.model, r.percentile): (r.threshold, r.tp, r.tn, r.fp, r.fn)
           for r in metrics.threshold_trials(df, (99, 90), benign_only=True).collect()}
    assert got[("a", 90)] == (pytest.approx(89.1), 1, 90, 10, 0) and got[("a", 99)] == (pytest.approx(98.01), 1, 99, 1, 0)
    assert got[(None, 99)] == (1.0, 1, 1, 0, 0) and got[("b", 99)] == (None, 0, 0, 0, 0)


def test_scratch_goes_with_the_application(tmp_path):
    code = ("import sys; sys.path.insert(0, {repo!r}); from flowlens.session import build_session, materialise;"
            "s = build_session('x', 'local[1]', spark__ui__enabled='false', spark__checkpoint__dir={shared!r});"
            "assert materialise(s.range(5), 'five').count() == 5; import glob; assert glob.glob({shared!r} + '/flowlens-*/five-*')")
    shared = tmp_path / "shared"
    shared.mkdir()
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code.format(repo=repo, shared=str(shared))], check=True, timeout=120)
    assert list(shared.glob("flowlens-*")) == []

# ---- sampling ------------------------------------------------------------------------------------------------------

def test_sample_is_exact_with_a_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(sampling, "MAX_RANKED", 20)
    data = [(1, 1.0)] * 400 + [(2, float(i)) for i in range(300)] + [(i, 0.0) for i in range(10, 310)]
    df = spark.createDataFrame(data, "k int, v double")
    for n in (0, 333, 2000):
        assert sampling.sample_n(df, ["k"], n).count() == min(n, 1000)
    train, test = sampling.stratified_split(df, ["k"], None, 0.25)
    assert test.count() == 250 and train.count() == 750
    assert train.unionAll(test).exceptAll(df).count() == 0


def test_split_does_not_depend_on_layout(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 7 == 0, None).otherwise(
        "b").alias("label"))
    wanted = None
    for partitions in (1, 4, 17):
        _, test = sampling.stratified_split(df.repartition(partitions).orderBy(F.rand(partitions)), ["id"], "label", 0.1)
        got = sorted(r["id"] for r in test.collect())
        assert wanted is None or got == wanted
        wanted = got
    counts = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    got = {r["label"]: r["count"] for r in test.groupBy("label").count().collect()}
    assert got == {k: math.ceil(v * 0.1) for k, v in counts.items()}


def test_repeat_rows_in_chunks(spark):
    df = spark.createDataFrame([("a", 25_001), ("b", 1)], "k string, n bigint")
    out = {r["k"]: r["count"] for r in sampling.repeat_rows(df, "n").groupBy("k").count().collect()}
    assert out == {"a": 25_001, "b": 1}


def test_cap_keeping_ratio(spark):
    df = spark.range(1000).select("id", (F.col("id") < 250).cast("int").alias("label"))
    capped = sampling.cap_keeping_ratio(df, ["id"], "label", 99)
    assert capped.count() == 99 and capped.where("label = 1").count() == 24
    assert sampling.cap_keeping_ratio(df, ["id"], "label", 5000).count() == 1000


def test_approximate_split_partitions_rows(spark):
    df = spark.range(2000)
    train, test = sampling.approximate_split(df, ["id"], 0.3)
    assert train.count() + test.count() == 2000 and 500 < test.count() < 700


def test_best_row_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 0.0)], "model string, f1 double")
    assert sampling.best_row(df, "f1", "model").first()["model"] == "a"
    assert sampling.best_row(df, "f1", "model", largest=False).first()["model"] == "c"


# ---- pipelines -----------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("leaky", [False, True])
def test_preprocess_on_generated_flows(spark, leaky, tmp_path):
    synthetic.synthetic_flows(spark, 2000).write.parquet(str(tmp_path / "flows"))
    df = spark.read.parquet(str(tmp_path / "flows")).select(
        "Flow Duration", "Total Fwd Packets", "Flow Bytes/s", "Flow Packets/s", "Fwd IAT Mean", "Label").withColumn(
        "Label", F.when(F.col("Total Fwd Packets") > 12, "PortScan").otherwise(F.col("Label")))
    out = preprocess(df, label="Label", leaky=leaky, handle_nan="median")
    stats = out.statistics.first()
    assert stats["initial_rows"] == 2100 and stats["final_rows"] == 2000
    assert stats["train_rows"] + stats["test_rows"] == 2000
    assert out.train.count() == stats["train_rows"]
    moments = out.train.agg(F.avg("Flow Duration").alias("m"), F.stddev_pop("Flow Duration").alias("s")).first()
    assert abs(moments["m"]) < 1e-9 and abs(moments["s"] - 1) < 1e-9
    assert set(r["Label"] for r in out.test.select("Label").distinct().collect()) == {0, 1}


def test_profile_report_writes_all_tables(spark, tmp_path):
    synthetic.synthetic_flows(spark, 500).write.parquet(str(tmp_path / "flows"))
    df = spark.read.parquet(str(tmp_path / "flows")).select("Flow Duration", "Flow Bytes/s", "Fwd IAT Mean", "Label")
    tables = profile_report(df, ["Flow Duration", "Flow Bytes/s", "Fwd IAT Mean"], "Label", str(tmp_path / "r"))
    assert set(tables) == {p.name for p in (tmp_path / "r").iterdir()}
    summary = tables["summary"].first()
    assert summary["duplicate_rows"] == 100
    assert summary["infinite_value_cols"] == 1 and summary["missing_value_cols"] == 1


def test_correlation_of_a_constant_column_is_missing(spark):
    from flowlens.operators import profile

    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 6.0, 5.0), (INF, 0.0, 5.0), (None, 1.0, 5.0)],
                               "a double, b double, c double")
    got = {(r["feature_a"], r["feature_b"]): r["r"] for r in profile.correlation(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(1.0) and got[("a", "c")] is None and got[("b", "c")] is None
    assert all(r["r"] is None for r in profile.correlation(df.limit(0), ["a", "b", "c"]).collect())
