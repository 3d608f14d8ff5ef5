"""Reactions as a stream: the batch operators over `readStream`, kept up to date in tables.

Sums of weights and latest reactions merge in any grouping, so the stream holds no state between micro-batches; see
`kept`. The tables grow with the number of their keys, not with the number of batches or events.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from digestry.operators import feedback
from digestry.streaming.kept import Kept, newest, sums


def read_log(spark: SparkSession, path: str, schema, files_per_batch: int | None = None,
             file_format: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def weights_table(path: str, key: str, per: Sequence[str] = ("user_id",), merge_every: int = 20) -> Kept:
    return Kept(path, (*per, key), sums("weight"), merge_every)


def maintain_weights(events: DataFrame, key: str, path: str, checkpoint: str,
                     per: Sequence[str] = ("user_id",), every: str | None = None, merge_every: int = 20) -> StreamingQuery:
    """Running preference weights, equal to `feedback.weights` over all events so far."""
    steps = (events.where(F.coalesce(F.col(key), F.lit("")) != "")
             .select(*per, key, feedback.step_of(F.col("reaction")).alias("weight")))
    return weights_table(path, key, per, merge_every).follow(steps, checkpoint, every)


def current_weights(spark: SparkSession, path: str, key: str, per: Sequence[str] = ("user_id",)) -> DataFrame:
    return weights_table(path, key, per).current(spark)


def latest_table(path: str, per: Sequence[str] = ("user_id",), merge_every: int = 20, remember: timedelta | None = None) -> Kept:
    def forgotten(rows: DataFrame) -> Column:
        return F.col("ts") < F.lit(rows.agg(F.max("ts")).first()[0]) - F.expr(f"INTERVAL {int(remember.total_seconds())} SECONDS")

    return Kept(path, (*per, "item_id"), newest("event_ord"), merge_every, forgotten if remember else None)


def maintain_latest(events: DataFrame, path: str, checkpoint: str, per: Sequence[str] = ("user_id",),
                    every: str | None = None, merge_every: int = 20, remember: timedelta | None = None) -> StreamingQuery:
    """Running latest reaction per reader and item, equal to `feedback.latest_reactions` over all events so far;
    `feedback.stats_of_latest` counts them.

    With `remember`, reactions that are older than the newest one (`ts`) by more than that are dropped when changes are
    merged, so the table ends with the readers' recent items. An item reacted to again comes back.
    """
    return latest_table(path, per, merge_every, remember).follow(events, checkpoint, every)


def current_latest(spark: SparkSession, path: str, per: Sequence[str] = ("user_id",)) -> DataFrame:
    return latest_table(path, per).current(spark)
