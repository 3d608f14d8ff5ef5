"""From collected items to the selection of each briefing."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.functions import text as X
from digestry.operators.ranking import passing_with_fallback
from digestry.operators.scoring import score_items
from digestry.operators.selection import has_room, select_top
from digestry.operators.titles import drop_similar_titles, marked, similar_marked
from digestry.session import settle
from digestry.settings import Settings

# What the later steps need of an item; long texts stay behind.
NARROW = ("brief_id", "ord", "item_id", "kind", "channel", "domain", "title", "duration", "url")


def curate(items: DataFrame, s: Settings, source_weights: DataFrame | None = None,
           domain_weights: DataFrame | None = None, per: Sequence[str] = (),
           keys: Sequence[str] = ("brief_id",), keep: Sequence[str] | None = None) -> DataFrame:
    """Score, threshold with fallback, drop similar titles, select under caps; adds `quality_score` and `pick`."""
    keep = list(keep or [c for c in NARROW if c in items.columns])
    columns = list(dict.fromkeys([*keep, *per]))

    def scored(rows: DataFrame) -> DataFrame:
        return (score_items(rows, s, source_weights, domain_weights, per, columns)
                .select(*keep, "quality_score"))

    # If some briefings need the complete path, only their items are scored again.
    return select_unique(scored(items), s, keys,
                         lambda briefs: scored(items.join(briefs, list(keys), "left_semi")))


def select_unique(scored: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",),
                  rows_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Threshold with fallback, removal of similar titles and selection in one pass where possible.

    A selection usually closes within its briefing's best rows. So only the best `head_rows` rows of each briefing
    are shuffled (the limit also applies before the shuffle) and walked in one array: similar to a kept title,
    caps, stop. A briefing is finished if its selection is full, if all its passing rows were among those, or if all
    its domains or channels are full. The others, usually none, take the complete operators over all their rows,
    which `rows_of` may give more cheaply than filtering `scored`.
    """
    keys = list(keys)
    floor = min(s.threshold, s.fallback_threshold)
    columns = [c for c in scored.columns if c not in keys]
    order = [F.col("quality_score").desc(), F.col("ord")]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    entry = F.struct((-F.col("quality_score")).alias("_worst"), F.col("ord").alias("_tie"),
                     marked(F.array_sort(X.title_tokens(F.col("title")))).alias("_set"),
                     F.coalesce("domain", F.lit("other")).alias("_domain"),
                     F.coalesce("channel", F.lit("")).alias("_channel"), F.struct(*columns).alias("_row"))
    head = (scored.where(F.col("quality_score") >= floor)
            .withColumn("_place", place).where(F.col("_place") <= s.head_rows + 1).drop("_place")
            .groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_entries")))
    limit = F.when(F.col("_entries")[0]["_worst"] <= -s.threshold, -s.threshold).otherwise(-s.fallback_threshold)
    head = (head.withColumn("_limit", limit)
            .withColumn("_passing", F.filter("_entries", lambda e: e["_worst"] <= F.col("_limit"))))

    sets0 = F.transform(F.slice("_passing", 1, 0), lambda e: e["_set"])
    start = F.struct(sets0.alias("kept"), F.slice("_passing", 1, 0).alias("taken"))

    def step(acc, e):
        known = F.exists(acc["kept"], lambda k: similar_marked(k, e["_set"]))
        return (F.when((F.size(acc["taken"]) >= s.total) | known, acc)
                .otherwise(F.struct(
                    F.array_append(acc["kept"], e["_set"]).alias("kept"),
                    F.when(has_room(acc["taken"], e["_domain"], e["_channel"], s), F.array_append(acc["taken"], e))
                    .otherwise(acc["taken"]).alias("taken"))))

    visible = F.slice("_passing", 1, s.head_rows)
    taken = F.aggregate(visible, start, step)["taken"]

    def full(name: str, cap: int) -> Column:
        names = F.array_distinct(F.transform("_taken", lambda t: t[name]))
        return F.filter(names, lambda n: F.size(F.filter("_taken", lambda t: t[name] == n)) >= cap)

    walked = (head.withColumn("_taken", taken)
              .withColumn("_closed", (F.size("_taken") >= s.total) | (F.size("_passing") <= s.head_rows))
              .withColumn("_full_domains", full("_domain", s.per_domain))
              .withColumn("_full_channels", full("_channel", s.per_channel))
              .select(*keys, "_closed", "_full_domains", "_full_channels",
                      F.posexplode(F.transform("_taken", lambda e: e["_row"])).alias("_at", "_row")))
    walked = settle(walked, "selection")
    done = walked.select(*keys, "_row.*", (F.col("_at") + 1).cast("bigint").alias("pick"), "_closed")
    unfilled = walked.where(~F.col("_closed") & (F.col("_at") == 0)).select(*keys, "_full_domains", "_full_channels")
    if unfilled.isEmpty():
        return done.drop("_closed")
    # A selection can also stay short because every domain or channel of its briefing is full. That takes two columns
    # of the items to see, not their scores.
    kinds = (scored.select(*keys, F.coalesce("domain", F.lit("other")).alias("_domain"),
                           F.coalesce("channel", F.lit("")).alias("_channel")).distinct())
    open_briefs = settle(
        kinds.join(unfilled, keys)
        .where(~F.array_contains("_full_domains", F.col("_domain"))
               & ~F.array_contains("_full_channels", F.col("_channel")))
        .select(*keys).distinct(), "open-briefs")
    if open_briefs.isEmpty():
        return done.drop("_closed")
    rows = rows_of(open_briefs) if rows_of else scored.join(open_briefs, keys, "left_semi")
    rest = settle(passing_with_fallback(rows, s, keys).drop("threshold_used"), "open-rows")
    return (done.drop("_closed").join(open_briefs, keys, "left_anti")
            .unionByName(select_top(drop_similar_titles(rest, s, keys, stored=True), s, keys)))


def funnel(scored: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """Per briefing: items collected, above the threshold, left after removing similar titles, selected."""
    keys = list(keys)
    # Scores are costly: store them once, with only the columns the rest looks at.
    slim = settle(scored.select(*keys, "ord", "domain", "channel", "title", "quality_score"), "scored")
    kept = settle(drop_similar_titles(slim.where(F.col("quality_score") >= s.threshold), s, keys, stored=True),
                  "unique-titles")
    selected = select_top(kept, s, keys).groupBy(*keys).agg(F.count("*").alias("selected"))
    unique = kept.groupBy(*keys).agg(F.count("*").alias("unique_titles"))
    counts = slim.groupBy(*keys).agg(F.count("*").alias("collected"),
                                     F.count_if(F.col("quality_score") >= s.threshold).alias("above_threshold"))
    return (counts.join(unique, keys, "left").join(selected, keys, "left")
            .select(*keys, "collected", "above_threshold", F.coalesce("unique_titles", F.lit(0)).alias("unique_titles"),
                    F.coalesce("selected", F.lit(0)).alias("selected")))
