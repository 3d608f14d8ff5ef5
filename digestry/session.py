"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", shuffle_partitions: int = 8, app: str = "digestry") -> SparkSession:
    """Session for tests and small trials. On a cluster the caller brings its own."""
    return (SparkSession.builder.master(f"local[{cores}]").appName(app)
            .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
            .config("spark.sql.adaptive.enabled", "true")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false")
            .config("spark.driver.memory", "8g")
            .getOrCreate())


def spread(rows: DataFrame, key: str, small_splits: int = 64) -> DataFrame:
    """Share out the rows of a small table whose few files or row groups would keep most cores idle.

    Tables of more splits, or of at least as many as there are cores, stay as they are.
    """
    cores, splits = rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()
    return rows.repartition(cores, key) if splits < min(cores, small_splits) else rows


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables: the one the cluster names. Only local runs get one of their own."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="digestry-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/digestry/{label}-{uuid.uuid4().hex}"


def settle(rows: DataFrame, label: str) -> DataFrame:
    """Write rows once and go on from the written table.

    This cuts the lineage of iterative steps and survives lost executors. Unlike `checkpoint()` it computes the
    plan once, and readers keep column pruning and a known size.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, label)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that `settle` wrote and nothing reads any more."""
    for rows in tables:
        context = rows.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in rows.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def _within(spark: SparkSession, setting: str, value: str) -> Iterator[None]:
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, value)
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def shuffles_end_with_queries(spark: SparkSession) -> AbstractContextManager[None]:
    """Within, what a query shuffled is deleted when the query ends, not when the driver's garbage is collected: for steps
    that go on from written tables."""
    return _within(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small_batches(spark: SparkSession, rows: int = 2048) -> AbstractContextManager[None]:
    """Within, tasks get whole texts in batches of at most so many rows, so that a batch takes little of an executor's memory."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(setting, "10000"))
    return _within(spark, setting, str(min(rows, now) if now > 0 else rows))
