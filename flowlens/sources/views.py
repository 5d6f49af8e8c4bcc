"""The given tables seen as flows, prediction log and wide vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.functions.numeric import rate
from flowlens.session import widen

FEATURES = ["flow_duration", "total_bytes", "bytes_per_s", "iat_mean", "const_zero"]
FLOW_KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
SIGNAL = {"DoS Hulk": 3.0, "PortScan": 1.5}
DIMENSIONS = 64


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = False) -> DataFrame:
    """A given table; ``heavy`` work per row is worth spreading a small file over all cores first."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return widen(scan) if heavy else scan


def flows(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """``lineitem`` as labelled flows, with infinite rates and missing values."""
    return flows_of(table(spark, sf_dir, "lineitem", heavy))


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a file stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def flows_of(li: DataFrame) -> DataFrame:
    label = F.when(F.col("l_returnflag") == "N", "BENIGN").when(F.col("l_returnflag") == "A", "DoS Hulk").otherwise(
        "PortScan")
    return li.select(
        *FLOW_KEYS,
        F.col("l_quantity").alias("flow_duration"),
        F.col("l_extendedprice").alias("total_bytes"),
        rate(F.col("l_extendedprice"), F.col("l_discount")).alias("bytes_per_s"),
        F.when(F.col("l_tax") != 0, F.col("l_tax")).alias("iat_mean"),
        F.lit(0.0).alias("const_zero"),
        label.alias("label"),
        F.date_format("l_shipdate", "EEEE").alias("day"),
    )


def flows_signal(spark: SparkSession, sf_dir: str, heavy: bool = False) -> DataFrame:
    """``flows`` with byte features raised for attacks, so that detection rates differ by class."""
    return signal_of(flows(spark, sf_dir, heavy))


def signal_of(df: DataFrame) -> DataFrame:
    factor = F.lit(1.0)
    for name, value in SIGNAL.items():
        factor = F.when(F.col("label") == name, F.lit(value)).otherwise(factor)
    return df.withColumns({
        "total_bytes": F.col("total_bytes") * factor,
        "bytes_per_s": F.col("bytes_per_s") * factor,
    })


def with_duplicates(df: DataFrame) -> DataFrame:
    """The frame plus a second copy of every port scan, as an input for duplicate removal."""
    return df.unionByName(df.where(F.col("label") == "PortScan"))


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a prediction log."""
    return log_of(table(spark, sf_dir, "events"))


def log_of(ev: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return ev.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        (F.col("event_type") == "error").cast("int").alias("prediction"),
        F.col("value").alias("anomaly_score"),
        F.least(F.col("value") / 100.0, F.lit(1.0)).alias("confidence"),
        F.when(F.col("user_id") < 50, "ocsvm").when(F.col("user_id") < 100, "vae").otherwise("forest").alias(
            "model_used"),
        k.alias("inference_time_ms"),
        F.create_map(F.lit("value"), F.col("value"), F.lit("k"), k).alias("features"),
        F.col("props").alias("metadata"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` as a wide feature table: columns ``f0`` .. ``f63``; label 0 is benign."""
    emb = table(spark, sf_dir, "embeddings", heavy=True)
    return emb.select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIMENSIONS)],
        F.when(F.col("label") == 0, "BENIGN").otherwise(F.concat(F.lit("attack-"), F.col("label"))).alias("label"),
    )


VECTOR_FEATURES = [f"f{i}" for i in range(DIMENSIONS)]

# Three simple scorers over ``flows_signal``; each flags what exceeds the 95th percentile of its benign scores.
SCORERS = {
    "bytes": lambda: F.col("total_bytes"),
    "duration": lambda: F.col("flow_duration"),
    "blend": lambda: F.col("total_bytes") / 1000.0 + F.col("flow_duration"),
}


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long scored frame: one row per (model, flow). Thresholds are exact percentiles and become literals."""
    from flowlens.operators.quantiles import exact_percentiles

    df = flows_signal(spark, sf_dir)
    thresholds = exact_percentiles(df.where(F.col("label") == "BENIGN"), {m: s() for m, s in SCORERS.items()}, [0.95])
    scores = F.array(*[
        F.struct(F.lit(m).alias("model"), s().alias("anomaly_score"), F.lit(thresholds[(m, 0.95)]).alias("threshold"))
        for m, s in SCORERS.items()
    ])
    return df.select(
        *FLOW_KEYS, "day", F.col("label").alias("label_original"),
        (~F.col("label").eqNullSafe("BENIGN")).cast("int").alias("label"), F.inline(scores),
    ).withColumn("prediction", (F.col("anomaly_score") > F.col("threshold")).cast("int"))
