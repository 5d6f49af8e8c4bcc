"""The registered queries: names, columns, and a cross-section of rows against SQL."""

import sys

import pytest
from oracle import compare, connect

import __spark_entry__ as entry

CROSS_SECTION = [
    "c11_clean", "c6_impute_median", "l2_encode_multiclass", "t1_stratified_split", "t4_cap_keeping_ratio",
    "e6_describe", "e8_histogram", "m3_roc_points", "m7_classification_report", "m9_per_attack",
    "m18_threshold_sensitivity", "d2_forest_score", "d13_reconstruction_error", "x2_top_features",
    "k2_recent_window", "k3_check_drift", "k7_streaming_scores", "w1_preprocess_statistics",
]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_operators_stand_without_the_training_data_folder(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert not any(name.startswith("op") or name == "pipeline" for name in entry.queries())
    assert len(entry.queries()) > 160


@pytest.mark.parametrize("name", CROSS_SECTION)
def test_query_equals_sql(spark, sf_dir, con, name):
    assert compare(entry.queries()[name](spark, sf_dir), con, entry.oracle_sql()[name]) == ""


def test_entry_has_rows(spark):
    got = {r["attack_type"]: r["detection_rate"] for r in entry.entry(spark).collect()}
    assert set(got) == {"DoS Hulk", "PortScan"} and got["DoS Hulk"] > got["PortScan"] > 0.05
