"""Pick the best items of a briefing under caps per domain, per channel and in total."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.settings import Settings


def _best(rows: DataFrame, groups: Sequence, order: Sequence, count: int) -> DataFrame:
    """Best rows of each group. Spark applies the limit before the shuffle as well, so no group gets large."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")


def with_room(rows: DataFrame, s: Settings, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Drop rows the capped walk can never take, leaving a fixed number per briefing.

    D, C, N = caps per domain, per channel, in total. A row is out of reach if
    1. min(D, C) rows of its domain and channel stand before it: one of the two is full by then;
    2. D + (N div C) * min(D, C) rows of its domain do: at most N div C channels fill up before the walk ends,
       and each can hold back only min(D, C) of them (after 1.);
    3. C + (N div D) * min(D, C) rows of its channel do, by the same reasoning;
    4. N + (N div D) * (bound of 2.) + (N div C) * (bound of 3.) rows of the briefing do: all that are not taken
       belong to a full domain or a full channel.
    Rows never taken do not use any cap, so leaving them out changes nothing.
    """
    both = min(s.per_domain, s.per_channel)
    in_domain = s.per_domain + (s.total // s.per_channel) * both
    in_channel = s.per_channel + (s.total // s.per_domain) * both
    in_brief = s.total + (s.total // s.per_domain) * in_domain + (s.total // s.per_channel) * in_channel
    rows = rows.withColumns({"_domain": F.coalesce("domain", F.lit("other")), "_channel": F.coalesce("channel", F.lit(""))})
    rows = _best(rows, [*keys, "_domain", "_channel"], order, both)
    rows = _best(rows, [*keys, "_domain"], order, in_domain)
    rows = _best(rows, [*keys, "_channel"], order, in_channel)
    return _best(rows, keys, order, in_brief)


def has_room(taken: Column, domain: Column, channel: Column, s: Settings) -> Column:
    """Whether a walk that has taken these entries can still take one of the given domain and channel."""
    return ((F.size(taken) < s.total)
            & (F.size(F.filter(taken, lambda t: t["_domain"] == domain)) < s.per_domain)
            & (F.size(F.filter(taken, lambda t: t["_channel"] == channel)) < s.per_channel))


def select_top(rows: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",), score: str = "quality_score",
               ordinal: str = "ord") -> DataFrame:
    """Walk each briefing in rank order and take what the caps allow; adds `pick`, the place in the selection."""
    columns = [c for c in rows.columns if c not in keys]
    order = [F.col(score).desc(), F.col(ordinal)]
    entry = F.struct((-F.col(score)).alias("_worst"), F.col(ordinal).alias("_tie"), "_domain", "_channel",
                     F.struct(*columns).alias("_row"))
    lists = (with_room(rows, s, keys, order).groupBy(*keys)
             .agg(F.array_sort(F.collect_list(entry)).alias("_walk")))
    empty = F.slice(F.col("_walk"), 1, 0)
    taken = F.aggregate("_walk", empty, lambda acc, e: F.when(
        has_room(acc, e["_domain"], e["_channel"], s), F.array_append(acc, e)).otherwise(acc))
    return (lists.select(*keys, F.posexplode(taken).alias("_at", "_e"))
            .select(*keys, *[F.col("_e._row")[c].alias(c) for c in columns],
                    (F.col("_at") + 1).cast("bigint").alias("pick")))
