"""The prediction log: append-only records, readable as a table or a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

LOG_SCHEMA = ("timestamp timestamp, prediction int, anomaly_score double, confidence double, model_used string, "
              "inference_time_ms double, features map<string,double>, metadata string")
LOG_COLUMNS = [part.split()[0] for part in LOG_SCHEMA.replace("map<string,double>", "map").split(", ")]
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # the default would cut microseconds
EXPORT_FORMATS = ("csv", "json")


def to_log(scored: DataFrame, model_used: str, features: list[str] | None = None, confidence: Column | None = None,
           inference_time_ms: Column | None = None, metadata: Column | None = None,
           timestamp: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Log records of a scored frame; works on streams."""
    packed = F.map_from_arrays(
        F.array(*[F.lit(f) for f in features]), F.array(*[F.col(f).cast("double") for f in features])
    ) if features else F.lit(None).cast("map<string,double>")
    return scored.select(
        *(keep or []),
        (timestamp if timestamp is not None else F.current_timestamp()).alias("timestamp"),
        F.col("prediction").cast("int").alias("prediction"),
        F.col("anomaly_score").cast("double").alias("anomaly_score"),
        (confidence if confidence is not None else F.col("confidence")).cast("double").alias("confidence"),
        F.lit(model_used).alias("model_used"),
        (inference_time_ms if inference_time_ms is not None else F.lit(None)).cast("double").alias("inference_time_ms"),
        packed.alias("features"),
        (metadata if metadata is not None else F.lit(None)).cast("string").alias("metadata"),
    )


def write_prediction_log(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Append records."""
    records.write.mode("append").option("timestampFormat", TIME_FORMAT).format(fmt).save(path)


def read_prediction_log(spark: SparkSession, path: str, fmt: str = "json", schema: str = LOG_SCHEMA) -> DataFrame:
    """S3: the schema is given, so no pass is spent on inferring it."""
    return spark.read.schema(schema).format(fmt).load(path)


def stream_prediction_log(spark: SparkSession, path: str, fmt: str = "json", schema: str = LOG_SCHEMA) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).load(path)


def export_logs(log: DataFrame, path: str, fmt: str = "csv") -> bool:
    """The log as CSV (maps as JSON text) or JSON lines; an empty log writes nothing and gives False."""
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"unsupported format '{fmt}'; use one of {EXPORT_FORMATS}")
    if log.isEmpty():
        return False
    if fmt == "csv":
        flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("map", "struct", "array") else F.col(f.name)
                for f in log.schema.fields]
        log.select(*flat).write.mode("overwrite").option("header", True).option(
            "timestampFormat", TIME_FORMAT).csv(path)
    else:
        log.write.mode("overwrite").option("timestampFormat", TIME_FORMAT).json(path)
    return True
