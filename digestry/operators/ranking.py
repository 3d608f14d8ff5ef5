"""Thresholds and ranks within a briefing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestry.settings import Settings


def passing(scored: DataFrame, s: Settings) -> DataFrame:
    return scored.where(F.col("quality_score") >= s.threshold)


def passing_with_fallback(scored: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """Apply the threshold, or the fallback threshold in briefings where nothing reaches it.

    The best score per briefing is pre-aggregated on the map side instead of a window, which would put a whole
    briefing into one task.
    """
    best = scored.groupBy(*keys).agg(F.max("quality_score").alias("_best"))
    limit = F.when(F.col("_best") >= s.threshold, s.threshold).otherwise(s.fallback_threshold)
    return (scored.where(F.col("quality_score") >= min(s.threshold, s.fallback_threshold))
            .join(best, list(keys))
            .withColumn("threshold_used", limit.cast("bigint"))
            .where(F.col("quality_score") >= F.col("threshold_used"))
            .drop("_best"))


def ranked(rows: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",), score: str = "quality_score",
           ordinal: str = "ord", out: str = "rank", sizes_from: DataFrame | None = None) -> DataFrame:
    """Rank by score, ties by ordinal (unique in a briefing), exact for briefings of any size.

    Briefings above `rank_group_rows` rows are cut into ordered pieces by (score, range of ordinals); each piece
    is sorted on its own and starts at the number of rows in the pieces before it. The list of such briefings has
    at most rows / rank_group_rows entries, which bounds what is broadcast. `sizes_from` may name a cheaper table
    with at least the same (keys, ordinal) to take the sizes from.
    """
    keys, limit = list(keys), s.rank_group_rows
    # Ranges as wide as it takes to spread the ordinals of a briefing over rows / limit of them.
    width = F.floor((F.col("_max") - F.col("_min")) / F.ceil(F.col("_n") / limit)) + 1
    large = ((sizes_from if sizes_from is not None else rows).groupBy(*keys)
             .agg(F.count("*").alias("_n"), F.min(ordinal).alias("_min"), F.max(ordinal).alias("_max"))
             .where(F.col("_n") > limit).select(*keys, width.alias("_width")))
    is_large = F.col("_width").isNotNull()
    pieces = (rows.join(F.broadcast(large), keys, "left")
              .withColumn("_piece_score", F.when(is_large, -F.col(score)).otherwise(0).cast("bigint"))
              .withColumn("_piece_range", F.when(is_large, F.floor(F.col(ordinal) / F.col("_width"))).otherwise(0)
                          .cast("bigint")))
    piece = [*keys, "_piece_score", "_piece_range"]
    before = (Window.partitionBy(*keys).orderBy("_piece_score", "_piece_range")
              .rowsBetween(Window.unboundedPreceding, -1))
    starts = (pieces.where(is_large).groupBy(*piece).agg(F.count("*").alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy(*piece).orderBy(F.col(score).desc(), F.col(ordinal))
    return (pieces.withColumn("_place", F.row_number().over(inside))
            .join(starts, piece, "left")
            .withColumn(out, F.col("_place") + F.coalesce(F.col("_start"), F.lit(0)))
            .drop("_width", "_piece_score", "_piece_range", "_place", "_start"))
