"""Alerts on major items as they land, without waiting for the daily run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from digestry.operators.scoring import score_items
from digestry.settings import Settings
from digestry.streaming.kept import table_if_any

ALERT_SCORE = 70


def alerts(items: DataFrame, s: Settings, at_least: int = ALERT_SCORE, landed: str = "landed_at", delay: str = "2 hours",
           keys: Sequence[str] = ("brief_id", "item_id"), keep: Sequence[str] = ("title", "channel", "domain", "url"),
           source_weights: DataFrame | None = None, domain_weights: DataFrame | None = None,
           per: Sequence[str] = ()) -> DataFrame:
    """(keys, keep, landed, quality_score) of streamed items that score enough, each key once.

    A key that lands again within `delay` is no new alert; once the watermark has passed that time, its key is forgotten
    and landing again is news. Items older than the watermark come too late and give none. State holds the keys of
    recent alerts, not all items: what scores less never reaches it. Of copies in one micro-batch any one is kept.
    Weights are tables as they were when the stream started.
    """
    columns = list(dict.fromkeys([*keys, *keep, landed, *per]))
    timed = items.where(F.col(landed).isNotNull()).withWatermark(landed, delay)
    scored = score_items(timed, s, source_weights, domain_weights, per, keep=columns)
    major = scored.where(F.col("quality_score") >= at_least)
    return major.dropDuplicatesWithinWatermark(list(keys)).drop(*[c for c in per if c not in (*keys, *keep)])


def follow(found: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Write alerts as they come, one partition a micro-batch; a repeated batch replaces its own, so none is sent twice."""

    def send(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (found.writeStream.outputMode("append").foreachBatch(send).option("checkpointLocation", checkpoint)
            .trigger(**({"processingTime": every} if every else {"availableNow": True})).start())


def sent(spark: SparkSession, path: str, after: int | None = None) -> DataFrame | None:
    """Alerts written so far (after a given batch), with their `batch_id`; None before the first batch."""
    rows = table_if_any(spark, path)
    return rows if rows is None or after is None else rows.where(F.col("batch_id") > after)
