"""A table of values by key that a stream keeps up to date.

Every micro-batch adds its changes as a partition of their own, reduced to one row a key; a batch that is repeated
replaces its partition. Changes of several batches merge into the same values in any grouping, so the stream itself
needs no state. After every so many batches all earlier changes are merged into one new table. Readers go on with the
last table and the changes since; what two mergers ago was current is deleted.

    changes/batch_id=N   what batch N changed
    merged/upto=N        all batches before N
    heads/upto=N         written after merged/upto=N is complete
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Kept:
    """`merge` reduces rows of equal keys to one, in as many steps as there may be: merge(merge(a) + b) = merge(a + b).
    `drop` says which merged rows need not be kept any longer."""

    path: str
    keys: tuple[str, ...]
    merge: Callable[[DataFrame, Sequence[str]], DataFrame]
    merge_every: int = 20
    drop: Callable[[DataFrame], Column] | None = None

    def _head(self, spark: SparkSession) -> int | None:
        heads = table_if_any(spark, f"{self.path}/heads")
        return None if heads is None else heads.agg(F.max("upto")).first()[0]

    def current(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The value of every key (of all batches before a given one)."""
        head, changes = self._head(spark), table_if_any(spark, f"{self.path}/changes")
        rows = None if changes is None else changes.where(F.col("batch_id") >= (head or 0))
        if rows is not None and before is not None:
            rows = rows.where(F.col("batch_id") < before)
        if rows is not None:
            rows = rows.drop("batch_id")
        if head is not None:
            merged = spark.read.parquet(f"{self.path}/merged/upto={head}")
            rows = merged if rows is None else merged.unionByName(rows)
        if rows is None:
            raise ValueError(f"no batch has been written to {self.path}")
        return self.merge(rows, self.keys)

    def add(self, changes: DataFrame, batch_id: int) -> None:
        self.merge(changes, self.keys).write.mode("overwrite").parquet(f"{self.path}/changes/batch_id={batch_id}")
        if batch_id and batch_id % self.merge_every == 0:
            self.merge_before(changes.sparkSession, batch_id)

    def merge_before(self, spark: SparkSession, batch_id: int) -> None:
        """Merge all batches before this one; they are complete, as it is running. Doing so again changes nothing."""
        last = self._head(spark)
        if last is not None and last >= batch_id:
            return
        rows = self.current(spark, batch_id)
        if self.drop is not None:
            rows = rows.where(~F.coalesce(self.drop(rows), F.lit(False)))
        rows.write.mode("overwrite").parquet(f"{self.path}/merged/upto={batch_id}")
        spark.range(1).write.mode("overwrite").parquet(f"{self.path}/heads/upto={batch_id}")
        if last is not None:
            _delete_below(spark, f"{self.path}/merged", "upto", last)
            _delete_below(spark, f"{self.path}/heads", "upto", last)
            _delete_below(spark, f"{self.path}/changes", "batch_id", last)

    def follow(self, changes: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Runs every so often (e.g. "1 minute"), or once over what has arrived."""
        return (changes.writeStream.outputMode("append").foreachBatch(self.add).option("checkpointLocation", checkpoint)
                .trigger(**({"processingTime": every} if every else {"availableNow": True})).start())


def sums(*values: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    return lambda rows, keys: rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def newest(order: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """The row of the greatest `order` per key."""
    def merge(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, order)]
        return rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last")).select(*keys, "_last.*")
    return merge


def table_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    """A partitioned table, or None before anything was written to it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _delete_below(spark: SparkSession, path: str, column: str, least: int) -> None:
    """Delete partitions `column`=N with N below `least`."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for entry in files.listStatus(folder):
        name, _, number = entry.getPath().getName().partition("=")
        if name == column and number.isdigit() and int(number) < least:
            files.delete(entry.getPath(), True)
