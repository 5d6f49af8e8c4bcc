"""Generated flows with the defects real captures show (S7), and a defect injector for any flow table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from flowlens.operators.sampling import mark_lowest, sample_n
from flowlens.spec import safe_name

# Name, mean and law of each generated feature; counts follow a Poisson law.
FEATURE_LAWS = [
    ("Flow Duration", 5000, "exponential"),
    ("Total Fwd Packets", 10, "count"),
    ("Total Backward Packets", 8, "count"),
    ("Total Length of Fwd Packets", 1000, "exponential"),
    ("Total Length of Bwd Packets", 800, "exponential"),
    ("Fwd Packet Length Max", 500, "exponential"),
    ("Fwd Packet Length Min", 50, "exponential"),
    ("Fwd Packet Length Mean", 200, "exponential"),
    ("Fwd Packet Length Std", 100, "exponential"),
    ("Bwd Packet Length Max", 450, "exponential"),
    ("Bwd Packet Length Min", 40, "exponential"),
    ("Bwd Packet Length Mean", 180, "exponential"),
    ("Bwd Packet Length Std", 90, "exponential"),
    ("Flow Bytes/s", 10000, "exponential"),
    ("Flow Packets/s", 100, "exponential"),
    ("Flow IAT Mean", 1000, "exponential"),
    ("Flow IAT Std", 500, "exponential"),
    ("Flow IAT Max", 2000, "exponential"),
    ("Flow IAT Min", 100, "exponential"),
    ("Fwd IAT Total", 5000, "exponential"),
    ("Fwd IAT Mean", 1000, "exponential"),
    ("Fwd IAT Std", 500, "exponential"),
    ("Fwd IAT Max", 2000, "exponential"),
    ("Fwd IAT Min", 100, "exponential"),
    ("Bwd IAT Total", 4500, "exponential"),
    ("Bwd IAT Mean", 900, "exponential"),
    ("Bwd IAT Std", 450, "exponential"),
    ("Bwd IAT Max", 1800, "exponential"),
    ("Bwd IAT Min", 90, "exponential"),
    ("Fwd PSH Flags", 1, "count"),
    ("Bwd PSH Flags", 1, "count"),
    ("Fwd URG Flags", 0.1, "count"),
    ("Bwd URG Flags", 0.1, "count"),
    ("Fwd Header Length", 40, "count"),
    ("Bwd Header Length", 35, "count"),
    ("Fwd Packets/s", 50, "exponential"),
    ("Bwd Packets/s", 40, "exponential"),
    ("Min Packet Length", 40, "exponential"),
    ("Max Packet Length", 500, "exponential"),
    ("Packet Length Mean", 200, "exponential"),
    ("Packet Length Std", 100, "exponential"),
    ("Packet Length Variance", 10000, "exponential"),
    ("FIN Flag Count", 1, "count"),
    ("SYN Flag Count", 1, "count"),
    ("RST Flag Count", 0.2, "count"),
    ("PSH Flag Count", 2, "count"),
    ("ACK Flag Count", 10, "count"),
    ("URG Flag Count", 0.1, "count"),
    ("CWE Flag Count", 0.1, "count"),
    ("ECE Flag Count", 0.1, "count"),
    ("Down/Up Ratio", 1, "exponential"),
    ("Average Packet Size", 200, "exponential"),
    ("Avg Fwd Segment Size", 180, "exponential"),
    ("Avg Bwd Segment Size", 160, "exponential"),
    ("Fwd Header Length.1", 40, "count"),
    ("Subflow Fwd Packets", 10, "count"),
    ("Subflow Fwd Bytes", 1000, "exponential"),
    ("Subflow Bwd Packets", 8, "count"),
    ("Subflow Bwd Bytes", 800, "exponential"),
    ("Init_Win_bytes_forward", 8000, "exponential"),
    ("Init_Win_bytes_backward", 7000, "exponential"),
    ("act_data_pkt_fwd", 5, "count"),
    ("min_seg_size_forward", 20, "exponential"),
    ("Active Mean", 1000, "exponential"),
    ("Active Std", 500, "exponential"),
    ("Active Max", 2000, "exponential"),
    ("Active Min", 100, "exponential"),
    ("Idle Mean", 5000, "exponential"),
    ("Idle Std", 2500, "exponential"),
    ("Idle Max", 10000, "exponential"),
    ("Idle Min", 500, "exponential"),
]
# Numbers of defective rows.
INFINITE_BYTES, INFINITE_PACKETS, MISSING_IAT, DUPLICATES = 50, 25, 30, 100


def feature_laws() -> list[tuple[str, float, bool]]:
    return [(safe_name(name), float(mean), law == "count") for name, mean, law in FEATURE_LAWS]


def _uniform(index: int, seed: int) -> Column:
    """A number in [0, 1) from the row id: the same for every partitioning."""
    return F.pmod(F.xxhash64("id", F.lit(index), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _poisson(u: Column, mean: float) -> Column:
    term, total, k, cdf = math.exp(-mean), 0.0, 0, []
    while total < 1.0 - 1e-12 and k < 1_000:
        total += term
        cdf.append(total)
        k += 1
        term *= mean / k
    return F.size(F.filter(F.array(*[F.lit(c) for c in cdf]), lambda c: c <= u)).cast("double")


def _lowest(n: int, index: int, seed: int) -> Column:
    """A rank in 0..n-1 per id, each used once: an affine map modulo n."""
    step = next(a for a in range(7919 + 2 * index + seed % 97, 10 * n + 20_000) if math.gcd(a, n) == 1)
    return F.pmod(F.col("id") * step + (seed * 31 + index * 17), F.lit(n))


def synthetic_flows(spark: SparkSession, n: int = 10_000, seed: int = 42) -> DataFrame:
    """``n`` benign flows plus 100 repeated rows, with infinite and missing values. Fully lazy."""
    columns = []
    for i, (name, mean, count) in enumerate(feature_laws()):
        u = _uniform(i, seed)
        columns.append((_poisson(u, mean) if count else -F.log(1.0 - u) * F.lit(mean)).alias(name))
    base = spark.range(n).select("id", *columns)
    infinite, missing = _lowest(n, 1, seed), _lowest(n, 2, seed)
    inf = F.lit(float("inf"))
    dirty = base.withColumns({
        "Flow Bytes/s": F.when(infinite < INFINITE_BYTES, inf).otherwise(F.col("`Flow Bytes/s`")),
        "Flow Packets/s": F.when(infinite < INFINITE_PACKETS, inf).otherwise(F.col("`Flow Packets/s`")),
        "Fwd IAT Mean": F.when(missing >= MISSING_IAT, F.col("`Fwd IAT Mean`")),
        "Label": F.lit("BENIGN"),
    })
    return dirty.unionByName(dirty.where(F.col("id") < DUPLICATES)).drop("id")


def inject_defects(df: DataFrame, keys: list[str], infinite: dict[str, int], missing: dict[str, int],
                   duplicates: int = 0, seed: int = 42) -> DataFrame:
    """Exactly the wanted numbers of infinite and missing values and of repeated rows, chosen by key hash.

    All infinite columns share one order, so a smaller number is a part of a larger one.
    """
    out = df
    for column, n in infinite.items():
        out = mark_lowest(out, keys, lambda size, n=n: F.lit(n), seed, flag="_hit").withColumn(
            column, F.when(F.col("_hit"), F.lit(float("inf"))).otherwise(F.col(column))).drop("_hit")
    for column, n in missing.items():
        out = mark_lowest(out, keys, lambda size, n=n: F.lit(n), seed + 1, flag="_hit").withColumn(
            column, F.when(~F.col("_hit"), F.col(column))).drop("_hit")
    return out.unionByName(sample_n(out, keys, duplicates, seed + 2)) if duplicates else out
