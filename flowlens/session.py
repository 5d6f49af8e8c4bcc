"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app_name: str = "flowlens", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine relies on; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "20000",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only for a local master."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="flowlens-")
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


_owned: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table, in this application's own folder inside the shared one.

    Lazy results read such tables, so they live as long as the application; the folder goes when the driver ends.
    """
    root = f"{shared_dir(spark).rstrip('/')}/flowlens-{spark.sparkContext.applicationId}"
    if root not in _owned:
        _owned.add(root)
        atexit.register(remove, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, if it is there."""
    jvm, context = spark.sparkContext._jvm, spark.sparkContext
    try:
        conf = context._jsc.hadoopConfiguration() if context._jsc else jvm.org.apache.hadoop.conf.Configuration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
    finally:
        _owned.discard(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: lineage is cut and executors may be lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame) -> DataFrame:
    """Cache a frame that several jobs read; lost blocks are recomputed from lineage."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def widen(scan: DataFrame) -> DataFrame:
    """A file scan with at least one partition per core.

    A small file with one row group is a single task, whatever the number of cores. Large inputs have more partitions
    than cores and stay as they are. Only for plain scans: asking a plan with shuffles for its partitions would run it.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def spread(df: DataFrame) -> DataFrame:
    """A cached frame with at least one partition per core, for jobs that read it many times."""
    cached = keep(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return keep(cached.repartition(cores)) if cached.rdd.getNumPartitions() < cores else cached
