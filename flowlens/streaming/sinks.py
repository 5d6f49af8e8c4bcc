"""Draining streams into tables of the shared folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.session import scratch_path

BATCH = "_batch"


def drain_to_table(stream: DataFrame, path: str | None = None, checkpoint: str | None = None,
                   output_mode: str = "append", transform: Callable[[DataFrame], DataFrame] | None = None,
                   timeout: int | None = None) -> tuple[DataFrame, list[dict]]:
    """Run a stream over all available input and return its table and the progress report of every batch.

    Every micro-batch overwrites its own folder, so a batch repeated after a failure leaves one copy. There is no time
    limit unless ``timeout`` (seconds) is given. The session keeps only the last reports of a stream, so each batch notes
    the report of the one before.
    """
    spark = stream.sparkSession
    path = path or scratch_path(spark, "stream")
    checkpoint = checkpoint or scratch_path(spark, "stream-checkpoint")

    reports: dict[tuple, dict] = {}
    started = []

    def note(reported) -> None:
        if reported is not None:
            report = dict(reported.asDict() if hasattr(reported, "asDict") else reported)
            reports[report["batchId"], str(report["timestamp"])] = report

    def write(batch: DataFrame, batch_id: int) -> None:
        if started:
            note(started[0].lastProgress)
        out = transform(batch) if transform else batch
        out.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    query = (stream.writeStream.outputMode(output_mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    started.append(query)
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"the stream did not finish within {timeout} s")
    finally:
        query.stop()
    for reported in query.recentProgress:
        note(reported)
    return read_batches(spark, path), list(reports.values())


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The drained table with the micro-batch number of every row."""
    return spark.read.option("basePath", path).parquet(f"{path}/{BATCH}=*")


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of every key of a table drained in update mode."""
    rest = [c for c in table.columns if c not in (*keys, BATCH)]
    row = F.max_by(F.struct(*rest), F.col(BATCH)).alias("row")
    return table.groupBy(*keys).agg(row).select(*keys, "row.*")


def late_rows(progress: list[dict]) -> int:
    """K8: rows dropped because they arrived behind the watermark."""
    return sum(int(s.get("numRowsDroppedByWatermark", 0)) for p in progress for s in p.get("stateOperators", []))
