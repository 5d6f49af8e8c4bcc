"""Preprocessing plans (W1, W2) and the profile report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.operators import profile
from flowlens.operators.clean import FlowCleaner, FlowCleanerModel, distinct_rows
from flowlens.operators.labels import binary_mapping, encode_binary, encode_multiclass, label_mapping
from flowlens.operators.sampling import mark_split
from flowlens.operators.scale import FlowScaler, FlowScalerModel
from flowlens.operators.schema import drop_metadata
from flowlens.session import keep
from flowlens.sources.flows import read_flows
from flowlens.sources.results import write_results
from flowlens.spec import RESCUED, numeric_columns


@dataclass
class Prepared:
    """Result of W1."""

    train: DataFrame
    test: DataFrame
    features: list[str]
    cleaner: FlowCleanerModel
    scaler: FlowScalerModel | None
    labels: DataFrame
    statistics: DataFrame


def load_and_clean(spark: SparkSession, paths: str | list[str], label: str = "Label", **options) -> DataFrame:
    """Scan and clean with statistics of the file itself."""
    flows = read_flows(spark, paths, label=label)
    return FlowCleaner(label=label, **options).fit(flows).transform(flows)


def preprocess(flows: DataFrame, features: list[str] | None = None, label: str = "label",
               keys: list[str] | None = None, test_size: float = 0.2, handle_inf: str = "replace",
               handle_nan: str = "drop", scaler: str | None = "standard", binary: bool = True, leaky: bool = False,
               seed: int = 42) -> Prepared:
    """Duplicates, split, clean, encode, scale.

    Cleaning and scaling statistics come from the training part; ``leaky=True`` takes the cleaning statistics from all
    rows. The split follows the hash of ``keys`` (all columns if none are given) and keeps class shares.
    """
    identity = list(keys or [])
    keys = identity or [c for c in flows.columns if c != RESCUED]
    features = features or [c for c in numeric_columns(drop_metadata(flows)) if c != label and c not in identity]
    rows = distinct_rows(flows)
    options = dict(handle_inf=handle_inf, handle_nan=handle_nan, remove_duplicates=False, label=label,
                   keep=identity)
    if leaky:
        cleaner = FlowCleaner(features, **options).fit(rows)
        cleaned = cleaner.transform(rows)
        carried = [k for k in keys if k in cleaned.columns]
        split = keep(mark_split(cleaned, carried or cleaned.columns, label, test_size, seed))
    else:
        marked = keep(mark_split(rows, keys, label, test_size, seed))
        cleaner = FlowCleaner(features, **options).fit(marked.where("not is_test").drop("is_test"))
        split = cleaner.transform(marked)
    encode = encode_binary if binary else encode_multiclass
    mapping = binary_mapping(flows, label) if binary else label_mapping(flows, label)
    encoded = encode(split, label)
    train, test = encoded.where("not is_test").drop("is_test"), encoded.where("is_test").drop("is_test")
    scaling = None
    if scaler:
        scaling = FlowScaler(cleaner.kept_features, scaler).fit(train)
        train, test = scaling.transform(train), scaling.transform(test)
    statistics = profile.pipeline_statistics(flows, split.drop("is_test"), label).withColumns({
        "train_rows": split.where("not is_test").agg(F.count("*")).scalar(),
        "test_rows": split.where("is_test").agg(F.count("*")).scalar(),
        "feature_count": F.lit(len(cleaner.kept_features)),
        "test_size": F.lit(float(test_size)),
        "scaler_type": F.lit(scaler),
        "binary_labels": F.lit(binary),
    })
    return Prepared(train, test, cleaner.kept_features, cleaner, scaling, mapping, statistics)


def preprocess_file(spark: SparkSession, paths: str | list[str], label: str = "Label", **options) -> Prepared:
    """W1 from files."""
    return preprocess(read_flows(spark, paths, label=label), label=label, **options)


def profile_report(flows: DataFrame, features: list[str], label: str = "label", folder: str | None = None,
                   fmt: str = "parquet") -> dict[str, DataFrame]:
    """All profile tables from two scans; written to ``folder`` if one is given."""
    tables = profile.full_profile(flows, features, label)
    if folder:
        write_results(tables, folder, fmt)
    return tables
