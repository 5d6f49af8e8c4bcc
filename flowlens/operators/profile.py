"""Exploratory profile of a flow table (E1-E12). Results are tidy: one row per feature, bin or pair."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.functions.numeric import finite, is_infinite, is_missing, long_form, null_if_nan
from flowlens.operators.clean import drop_infinite
from flowlens.operators.quantiles import ACCURACY, MAX_LISTED, NARROW, WIDE, exact_percentiles
from flowlens.session import materialise
from flowlens.spec import BENIGN, numeric_columns

HIGH_CORRELATION = 0.9  # fixed value
BINS = 50               # fixed value
PAIRWISE_UP_TO = 20     # beyond, one Gram matrix is cheaper than an aggregate per pair


def schema_report(df: DataFrame) -> DataFrame:
    """Position, type, row and non-null count per column."""
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}")
                                                   for i, c in enumerate(df.columns)])
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"),
                 F.lit(f.dataType.simpleString()).alias("type"), F.col("_rows").alias("rows"),
                 F.col(f"n{i}").alias("non_null"))
        for i, f in enumerate(df.schema.fields)
    ]
    return counts.select(F.inline(F.array(*entries)))


def defect_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """E2 and E3 in one pass: missing and infinite count and percent per feature."""
    value = F.col("value")
    return long_form(df, features).groupBy("feature").agg(
        F.count_if(is_missing(value)).alias("missing_count"),
        F.count_if(is_infinite(value)).alias("infinite_count"),
        F.count("*").alias("rows"),
    ).select(
        "feature", "missing_count", (F.col("missing_count") * 100.0 / F.col("rows")).alias("missing_percent"),
        "infinite_count", (F.col("infinite_count") * 100.0 / F.col("rows")).alias("infinite_percent"),
    )


def missing_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Features with missing values, most first."""
    return defect_profile(df, features).where("missing_count > 0").select(
        "feature", "missing_count", "missing_percent").orderBy(F.col("missing_count").desc(), "feature")


def infinite_profile(df: DataFrame, features: list[str]) -> DataFrame:
    """Features with infinite values, most first."""
    return defect_profile(df, features).where("infinite_count > 0").select(
        "feature", "infinite_count", "infinite_percent").orderBy(F.col("infinite_count").desc(), "feature")


def duplicate_profile(df: DataFrame) -> DataFrame:
    """Extra copies of whole rows; copies are counted before the shuffle."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("rows"),
    ).withColumn("duplicate_percent",
                 F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(F.col("duplicate_rows") * 100.0 / F.col("rows")))


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles of finite and non-missing values."""
    quartiles = exact_percentiles(df, {f: null_if_nan(F.col(f)) for f in features}, [0.25, 0.5, 0.75])
    value = null_if_nan(F.col("value"))
    stats = long_form(df, features).groupBy("feature").agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))
    lookup = F.lit(None).cast("struct<p25:double,p50:double,p75:double>")
    for f in features:
        q = [F.lit(quartiles[(f, p)]).cast("double") for p in (0.25, 0.5, 0.75)]
        lookup = F.when(F.col("feature") == f,
                        F.struct(q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"))).otherwise(lookup)
    return stats.withColumn("_q", lookup).select("feature", "count", "mean", "std", "min", "_q.p25", "_q.p50",
                                                 "_q.p75", "max")


def constant_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Features with exactly one distinct non-missing value; no distinct count is needed."""
    value = null_if_nan(F.col("value"))
    return long_form(df, features).groupBy("feature").agg(
        F.min(value).alias("low"), F.max(value).alias("high")
    ).where("low = high").select("feature", F.col("low").alias("value"))


def histogram(df: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """Equal bins between the finite extremes of each feature; the last bin is closed on the right."""
    x = finite(F.col("value"))
    values = long_form(df, features).select("feature", x.alias("value")).where(F.col("value").isNotNull())
    ranges = {r["feature"]: (r["lo"], r["hi"]) for r in values.groupBy("feature").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")).collect()}
    low = width = F.lit(None).cast("double")
    for f, (lo, hi) in ranges.items():
        low = F.when(F.col("feature") == f, F.lit(lo)).otherwise(low)
        width = F.when(F.col("feature") == f, F.lit((hi - lo) / bins)).otherwise(width)
    position = F.when(F.col("width") == 0, F.lit(0.0)).otherwise(F.floor((F.col("value") - F.col("low")) / F.col("width")))
    return (
        values.withColumns({"low": low, "width": width})
        .withColumn("bin", F.least(position, F.lit(float(bins - 1))).cast("int"))
        .groupBy("feature", "bin", "low", "width").agg(F.count("*").alias("count"))
        .select("feature", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("bin_start"), "count")
    )


def correlation(df: DataFrame, features: list[str]) -> DataFrame:
    """Pearson matrix over rows whose features are all finite, as (feature_a, feature_b, r) with a before b."""
    if len(features) > PAIRWISE_UP_TO:
        return _correlation_table(df, features, _gram_correlation(df, features))
    row = df.agg(*_pair_columns(features)).first()
    return _correlation_table(df, features, lambda i, j: _pair_correlation(row, i, j))


def _gram_correlation(df: DataFrame, features: list[str]):
    complete = drop_infinite(df.select(*[null_if_nan(F.col(f).cast("double")).alias(f) for f in features]),
                             features).na.drop()
    assembled = VectorAssembler(inputCols=features, outputCol="v").transform(complete).select("v")
    matrix = Correlation.corr(assembled, "v").first()[0].toArray()
    return lambda i, j: float(matrix[i, j])


def _pair_columns(features: list[str]) -> list[Column]:
    """Sums behind the correlation of all pairs; a row with a missing or infinite feature counts for none."""
    values = [finite(F.col(f"`{f}`").cast("double")) for f in features]
    whole = reduce(lambda a, b: a & b, [v.isNotNull() for v in values])
    own = [F.when(whole, v) for v in values]
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    # corr itself fails on a constant column under ANSI rules, so the division is done later, on a handful of numbers.
    return [*[F.covar_pop(own[i], own[j]).alias(f"c{i}_{j}") for i, j in pairs],
            *[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(own)]]


def _pair_correlation(row, i: int, j: int) -> float | None:
    spread = (row[f"s{i}"] or 0.0) * (row[f"s{j}"] or 0.0)
    return max(-1.0, min(1.0, row[f"c{i}_{j}"] / spread)) if spread else None


def _correlation_table(df: DataFrame, features: list[str], value) -> DataFrame:
    table = []
    for i in range(len(features)):
        for j in range(i + 1, len(features)):
            r = value(i, j)
            table.append((features[i], features[j], None if r is None or r != r else r))
    return df.sparkSession.createDataFrame(table, "feature_a string, feature_b string, r double")


def high_correlation_pairs(matrix: DataFrame, limit: float = HIGH_CORRELATION, n: int | None = 10) -> DataFrame:
    """Strongest pairs above the limit."""
    strong = matrix.where(F.abs("r") > limit).orderBy(F.abs("r").desc(), "feature_a", "feature_b")
    return strong if n is None else strong.limit(n)


def quality_summary(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """The profile in one row."""
    return full_profile(df, features, label)["summary"]


def full_profile(df: DataFrame, features: list[str], label: str = "label", bins: int = BINS) -> dict[str, DataFrame]:
    """E1-E11 as tables from two scans of ``df`` (one more for the correlation of over 20 features).

    The first is one aggregate: counts, moments, extremes, correlation sums and a sketch of every feature. The second counts
    by bin, by value within the narrow bands around the quartiles, by label and by row, in one long form: what is written is
    a row per bin, listed value and label. Quartiles whose bands hold too many values are found by passes of their own.
    """
    scan = _first_scan(df, features)
    n, stats = scan["rows"], scan["stats"]
    bands = {i: _bands(s) for i, s in enumerate(stats)}
    listed = sum(min(1.0, high_share) * s["count"] for i, s in enumerate(stats) for *_, high_share in bands[i])
    counted = _second_scan(df, features, label, stats, bands if listed <= MAX_LISTED else {}, bins)
    rows = counted.where("c >= 0").collect()
    quartiles = _quartiles(df, features, rows, stats, bands if listed <= MAX_LISTED else None)

    spark = df.sparkSession
    frame = spark.createDataFrame
    described, defects, constants, histogram_rows = [], [], [], []
    for i, (f, s) in enumerate(zip(features, stats)):
        described.append((f, s["count"], s["mean"], s["std"], s["min"], *quartiles[i], s["max"]))
        percent = [100.0 * s[k] / n if n else 0.0 for k in ("missing", "infinite")]
        defects.append((f, s["missing"], percent[0], s["infinite"], percent[1]))
        if s["min"] is not None and s["min"] == s["max"]:
            constants.append((f, s["min"]))
        by_bin: dict[int, int] = {}
        for row in rows:
            if row["c"] == i and row["bin"] is not None:
                by_bin[row["bin"]] = by_bin.get(row["bin"], 0) + row["n"]
        width = (s["hi"] - s["lo"]) / bins if by_bin else 0.0
        histogram_rows += [(f, b, s["lo"] + b * width, count) for b, count in sorted(by_bin.items())]
    defect_table = frame(defects, "feature string, missing_count bigint, missing_percent double, infinite_count bigint, "
                                  "infinite_percent double")
    copies = counted.where("c = -2").agg(
        F.coalesce(F.sum("extra"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("rows"))
    duplicates = copies.withColumn("duplicate_percent", F.when(F.col("rows") == 0, F.lit(0.0)).otherwise(
        F.col("duplicate_rows") * 100.0 / F.col("rows")))
    labels = counted.where("c = -1").select(F.col("t").alias(label), F.col("n").alias("count"))
    matrix = _correlation_table(df, features, scan["correlation"])
    strong = high_correlation_pairs(matrix)
    summary = duplicates.select(
        F.col("rows").alias("total_rows"), F.lit(len(features)).alias("total_features"),
        F.lit(len([c for c in features if c in numeric_columns(df)])).alias("numeric_features"),
        F.lit(sum(d[1] > 0 for d in defects)).cast("bigint").alias("missing_value_cols"),
        F.lit(sum(d[3] > 0 for d in defects)).cast("bigint").alias("infinite_value_cols"),
        "duplicate_rows", "duplicate_percent", F.lit(len(constants)).cast("bigint").alias("constant_features"),
        high_correlation_pairs(matrix, n=None).agg(F.count("*")).scalar().alias("high_corr_pairs"),
        labels.agg(F.count(label)).scalar().alias("unique_labels"))
    return {
        "schema": frame([(i, f.name, f.dataType.simpleString(), n, scan["filled"][i]) for i, f in enumerate(df.schema.fields)],
                        "position int, column string, type string, rows bigint, non_null bigint"),
        "missing": defect_table.where("missing_count > 0").select("feature", "missing_count", "missing_percent").orderBy(
            F.col("missing_count").desc(), "feature"),
        "infinite": defect_table.where("infinite_count > 0").select("feature", "infinite_count", "infinite_percent").orderBy(
            F.col("infinite_count").desc(), "feature"),
        "duplicates": duplicates,
        "labels": labels.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy())),
        "describe": frame(described, "feature string, count bigint, mean double, std double, min double, p25 double, "
                                     "p50 double, p75 double, max double"),
        "constant": frame(constants, "feature string, value double"),
        "histogram": frame(histogram_rows, "feature string, bin int, bin_start double, count bigint"),
        "correlation": matrix, "high_correlation": strong, "summary": summary,
    }


QUARTILES = (0.25, 0.5, 0.75)
_PROBES = [q for p in QUARTILES for q in (p - NARROW, p + NARROW, p - WIDE, p + WIDE)]


def _feature_columns(x: Column) -> dict[str, Column]:
    value, inside = null_if_nan(x), finite(x)
    return {"missing": F.count_if(is_missing(x)), "infinite": F.count_if(is_infinite(x)), "count": F.count(value),
            "mean": F.avg(value), "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value),
            "lo": F.min(inside), "hi": F.max(inside), "q": F.percentile_approx(value, _PROBES, ACCURACY)}


def _first_scan(df: DataFrame, features: list[str]) -> dict:
    counts = [F.count("*").alias("_rows"), *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)]]
    names = list(_feature_columns(F.lit(0.0)))
    if len(features) <= PAIRWISE_UP_TO:
        own = [c.alias(f"{name}_{i}") for i, f in enumerate(features)
               for name, c in _feature_columns(F.col(f"`{f}`").cast("double")).items()]
        row = df.agg(*counts, *own, *_pair_columns(features)).first()
        stats = [{name: row[f"{name}_{i}"] for name in names} for i in range(len(features))]
        return {"rows": row["_rows"], "filled": [row[f"n{i}"] for i in range(len(df.columns))], "stats": stats,
                "correlation": lambda i, j: _pair_correlation(row, i, j)}
    row = df.agg(*counts).first()
    long = long_form(df, [f"`{f}`" for f in features]).groupBy("feature").agg(
        *[c.alias(name) for name, c in _feature_columns(F.col("value")).items()])
    by_feature = {r["feature"].strip("`"): r.asDict() for r in long.collect()}
    empty = dict.fromkeys(names) | {"missing": 0, "infinite": 0, "count": 0}
    return {"rows": row["_rows"], "filled": [row[f"n{i}"] for i in range(len(df.columns))],
            "stats": [by_feature.get(f, empty) for f in features], "correlation": _gram_correlation(df, features)}


def _bands(s: dict) -> list[tuple]:
    """(first rank, last rank, weight, low, high, expected share of the rows inside) around each quartile."""
    n, out = s["count"], []
    for j, p in enumerate(QUARTILES):
        position = p * (n - 1)
        first = math.floor(position) if n else 0
        margin, at = (NARROW, 4 * j) if n * NARROW >= 3 else (WIDE, 4 * j + 2)
        enough = n * margin >= 3
        low, high = (s["q"][at], s["q"][at + 1]) if enough else (s["min"], s["max"])
        out.append((first, min(first + 1, max(n - 1, 0)), position - first, low, high, 4 * margin if enough else 1.0))
    return out


def _second_scan(df: DataFrame, features: list[str], label: str, stats: list[dict], bands: dict, bins: int) -> DataFrame:
    """``c, t, bin, v, n, extra, b0..b2``: rows by feature (c >= 0), by label (-1) and copies of whole rows (-2)."""
    d = len(features)
    plain = [F.col(f"`{f.name}`") + F.lit(0.0) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
             for f in df.schema.fields]  # -0.0 is 0.0
    row = F.md5(F.to_json(F.struct(*[c.alias(f"f{i}") for i, c in enumerate(plain)])))
    text = F.col(f"`{label}`").cast("string") if label in df.columns else F.lit(None).cast("string")
    entries = [F.struct(F.lit(i).alias("c"), F.lit(None).cast("string").alias("t"), null_if_nan(F.col(f"`{f}`").cast("double"))
                        .alias("x")) for i, f in enumerate(features)]
    none = F.lit(None).cast("double").alias("x")
    entries += [F.struct(F.lit(-1).alias("c"), text.alias("t"), none), F.struct(F.lit(-2).alias("c"), row.alias("t"), none)]

    def per_feature(values: dict[int, float | None]) -> Column:
        numbers = [values.get(i) for i in range(d)]
        literals = ", ".join("cast(null as double)" if v is None else f"double('{float(v)!r}')" for v in numbers)
        return F.when(F.col("c") >= 0, F.element_at(F.expr(f"array({literals})"), F.greatest(F.col("c"), F.lit(0)) + 1))

    x = F.col("x")
    low, width = per_feature({i: s["lo"] for i, s in enumerate(stats)}), per_feature(
        {i: (s["hi"] - s["lo"]) / bins for i, s in enumerate(stats) if s["lo"] is not None})
    place = F.when(width == 0, F.lit(0.0)).otherwise(F.floor((finite(x) - low) / width))
    edges = [(per_feature({i: b[j][3] for i, b in bands.items()}), per_feature({i: b[j][4] for i, b in bands.items()}))
             for j in range(len(QUARTILES))]
    inside = reduce(lambda a, b: a | b, [F.coalesce(x.between(lo, hi), F.lit(False)) for lo, hi in edges])
    keyed = df.select(F.inline(F.array(*entries))).select(
        "c", "t", F.when(place.isNotNull(), F.least(place, F.lit(float(bins - 1)))).cast("int").alias("bin"), F.when(inside, x).alias("v"),
        *[(x < lo).alias(f"b{j}") for j, (lo, _) in enumerate(edges)])
    groups = keyed.groupBy("c", "t", "bin", "v").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(f"b{j}")).alias(f"b{j}") for j in range(len(edges))])
    shown = F.when(F.col("c") != -2, F.col("t"))  # rows are only counted
    return materialise(groups.groupBy("c", shown.alias("t"), "bin", "v").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("extra"),
        *[F.sum(f"b{j}").alias(f"b{j}") for j in range(len(edges))]), "profile")


def _quartiles(df: DataFrame, features: list[str], rows: list, stats: list[dict], bands: dict | None) -> list[tuple]:
    if bands is None:
        exact = exact_percentiles(df, {str(i): null_if_nan(F.col(f"`{f}`").cast("double")) for i, f in enumerate(features)},
                                  list(QUARTILES))
        return [tuple(exact[(str(i), p)] for p in QUARTILES) for i in range(len(features))]
    found = []
    for i, s in enumerate(stats):
        own, values = [r for r in rows if r["c"] == i], {}
        for r in own:
            if r["v"] is not None:
                values[r["v"]] = values.get(r["v"], 0) + r["n"]
        made: list[float | None] = []
        for j, (first, last, weight, low, high, _) in enumerate(bands[i]):
            upto, at = sum(r[f"b{j}"] for r in own), {}
            for v in sorted(v for v in values if s["count"] and low <= v <= high):
                for rank in (first, last):
                    if upto <= rank < upto + values[v]:
                        at[rank] = v
                upto += values[v]
            if s["count"] and not {first, last} <= at.keys():
                raise RuntimeError("a quartile lies outside its band")
            a, z = at.get(first), at.get(last)
            made.append(None if a is None else a if a == z else a + (z - a) * weight)
        found.append(tuple(made))
    return found


def pipeline_statistics(before: DataFrame, after: DataFrame, label: str = "label",
                        benign: str = BENIGN) -> DataFrame:
    """Shapes, rows removed, benign and attack counts and the attack ratio."""
    initial = before.agg(F.count("*")).scalar()
    is_benign = F.col(label).eqNullSafe(benign)
    return after.agg(
        F.count("*").alias("final_rows"), F.count_if(is_benign).alias("benign"),
        F.count_if(~is_benign).alias("attacks"),
    ).select(
        initial.alias("initial_rows"), F.lit(len(before.columns)).alias("initial_columns"), "final_rows",
        F.lit(len(after.columns)).alias("final_columns"), (initial - F.col("final_rows")).alias("rows_removed"),
        "benign", "attacks",
        F.when(F.col("final_rows") == 0, F.lit(0.0)).otherwise(F.col("attacks") / F.col("final_rows")).alias(
            "attack_ratio"),
    )


def attack_counts(df: DataFrame, label: str = "label", benign: str = BENIGN) -> DataFrame:
    """Rows per attack label."""
    return df.where(~F.col(label).eqNullSafe(benign)).groupBy(label).agg(F.count("*").alias("count"))
