"""One run from landed data to documents and messages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestry import schema
from digestry.operators import briefing, card
from digestry.plans.curate import curate
from digestry.session import settle
from digestry.settings import Settings
from digestry.sources import videos as V
from digestry.sources.feeds import feed_entries


def collect_videos(payloads: DataFrame, snippets: DataFrame, s: Settings,
                   script_table: tuple[str, str] | None = None) -> DataFrame:
    """Videos of subscribed channels, then of keyword searches; the first mention of a video counts.

    Of a video that landed several times the newest copy counts (`landed`, if the responses have it), then the one of
    most views; what is left to tell copies apart is a hash of all they say.

    Transcripts are joined to the few videos that remain, not to everything that was landed.
    """
    landed = V.flatten_payloads(payloads)
    said = F.xxhash64(*landed.columns)
    newest = F.struct(*([F.col("landed")] if "landed" in landed.columns else []), "views", "likes", "comments", said)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(newest.desc()))
    landed = landed.withColumn("_n", place).where(F.col("_n") == 1).drop("_n", "landed").withColumn("ord", F.xxhash64("item_id"))
    common = ["item_id", "domain", "_order"]
    subscribed = V.latest_of_channels(landed, s).withColumn(
        "_order", F.struct(F.lit(0).alias("mode"), F.col("channel_ord").alias("at"), F.col("place").alias("place")))
    found = V.best_of_keywords(landed, s).withColumn(
        "_order", F.struct(F.lit(1).alias("mode"), F.col("keyword_ord").alias("at"), F.col("place").alias("place")))
    chosen = V.first_per_id(subscribed.select(*common).unionByName(found.select(*common)), "_order")
    chosen = settle(chosen, "chosen-videos")
    rows = landed.drop("ord").join(chosen, "item_id")
    texts = V.transcripts(snippets.join(chosen.select(F.col("item_id").alias("video_id")), "video_id", "left_semi"))
    rows = V.with_transcripts(rows, texts.withColumnRenamed("video_id", "item_id"), "item_id")
    if script_table:
        rows = V.simplified(rows, script_table, ("title", "channel", "description", "transcript"))
    return _numbered(rows.withColumn("_at", F.struct("_order.mode", "_order.at", "_order.place")))


def collect_articles(documents: DataFrame, feeds: DataFrame, s: Settings,
                     script_table: tuple[str, str] | None = None) -> DataFrame:
    """Articles of the feeds. Of several fetches of a feed the newest comes first, and an article that occurs again,
    within a document or in another fetch, counts at its first place."""
    rows = feed_entries(documents, s, feeds, script_table)
    if "fetch" not in rows.columns:
        rows = rows.withColumn("fetch", F.lit(""))
    order = [F.col("fetch").desc(), F.col("entry_no"), F.xxhash64("title", "description")]
    first = F.row_number().over(Window.partitionBy("feed_ord", "item_id").orderBy(*order))
    rows = rows.withColumn("_n", first).where(F.col("_n") == 1).drop("_n")
    # A feed has the entries of one day only, so its articles fit a task.
    place = F.row_number().over(Window.partitionBy("feed_ord").orderBy(*order, "item_id")) - 1
    return _numbered(rows.withColumn("_at", F.struct(F.lit(2).alias("mode"), F.col("feed_ord").cast("bigint").alias("at"),
                                                     place.cast("bigint").alias("place"))).drop("fetch"))


def _numbered(rows: DataFrame) -> DataFrame:
    """Ordinal from (mode, place of the rule, place within it): places below 10^9, rules below 10^6."""
    return rows.withColumn("ord", (F.col("_at.mode").cast("bigint") * 1_000_000 + F.col("_at.at")) * 1_000_000_000
                           + F.col("_at.place"))


def as_items(sources: Sequence[DataFrame], brief_id: int) -> DataFrame:
    """All collected rows in the layout of items."""
    out = None
    for rows in sources:
        have = set(rows.columns)
        rows = rows.withColumn("brief_id", F.lit(brief_id).cast("bigint")).select(*[
            (F.col(f.name) if f.name in have or f.name == "brief_id" else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.ITEMS.fields])
        out = rows if out is None else out.unionByName(rows)
    return out


@dataclass(frozen=True)
class Run:
    selected: DataFrame
    item_prompts: DataFrame
    trend_prompts: DataFrame
    documents: DataFrame
    messages: DataFrame


def brief(items: DataFrame, s: Settings, responses: DataFrame, trends: DataFrame | None = None,
          source_weights: DataFrame | None = None, domain_weights: DataFrame | None = None,
          per: Sequence[str] = ()) -> Run:
    """Curate items and put documents and messages together. Prompts are for an external model to answer."""
    selected = settle(curate(items, s, source_weights, domain_weights, per), "selected")
    texts = items.select("brief_id", "ord", "description",
                         *([F.col("transcript")] if "transcript" in items.columns else []))
    picked = settle(selected.join(texts, ["brief_id", "ord"]), "selected-texts")
    summarised = briefing.attach_summaries(picked, responses)
    totals = items.groupBy("brief_id").agg(F.count("*").alias("collected"))
    docs = settle(briefing.documents(summarised, totals, s, trends), "documents")
    prompts = picked if "transcript" in picked.columns else picked.withColumn("transcript", F.lit(""))
    return Run(selected, briefing.item_prompts(prompts).select("brief_id", "item_id", "prompt"),
               briefing.trend_prompts(summarised), docs, card.payloads(docs, s))
