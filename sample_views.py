"""The driver's test tables in the shape the operators expect. Each view reads whole tables."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry import Settings
from digestry.operators import briefing, feedback
from digestry.operators.scoring import score_items
from digestry.plans.curate import curate
from digestry.plans.daily import brief
from digestry.session import spread

# The test tables are invented prose, so the rules are syllables of it.
SETTINGS = Settings(
    as_of=datetime(2024, 1, 31, tzinfo=timezone.utc),
    domain_keywords=(("AI", ("theer", "onon", "thethe", "tionsh")),
                     ("芯片", ("eauxeaux", "mentment", "ientola")),
                     ("机器人", ("keitkeit", "lichund", "cióncción"))),
    whitelist=("src0", "src1", "src2", "src3", "src4"),
    spam_keywords=("!!", "copyright", "license"),
    search_keywords=(("AI", ("theer", "onon", "thethe")), ("芯片", ("eauxeaux", "mentment")),
                     ("机器人", ("keitkeit", "lichund"))),
    channels=(("src0", "AI"), ("src3", "芯片"), ("src7", "机器人"), ("src8", "AI"), ("src13", "芯片"),
              ("src19", "机器人")),
)

KEYS_AND_SCORE = ("brief_id", "ord", "item_id", "quality_score")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def items(spark: SparkSession, folder: str, docs: DataFrame | None = None) -> DataFrame:
    """Documents (or those given, such as a stream) as collected items; one briefing per 100 documents, each with its own
    reader."""
    docs, events = spread(table(spark, folder, "documents"), "doc_id") if docs is None else docs, table(spark, folder, "events")

    def total(kind: str, factor: int):
        return F.sum(F.when(F.col("event_type") == kind, F.floor(F.col("value") * factor)).otherwise(0))

    counts = events.groupBy("user_id").agg(total("view", 100).alias("v"), total("click", 20).alias("l"),
                                           total("purchase", 2).alias("c"))
    joined = docs.withColumn("_u", F.expr("doc_id div 8")).join(counts.withColumnRenamed("user_id", "_u"), "_u", "left")
    headline = F.substring_index(F.substring_index("text", "\n", 1), ". ", 1)
    return joined.select(
        F.expr("doc_id div 100").alias("brief_id"), F.expr("doc_id div 100").alias("user_id"),
        F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("item_id"),
        F.expr("CASE WHEN doc_id % 2 = 0 THEN 'YouTube' ELSE 'RSS' END").alias("kind"),
        F.col("source").alias("channel"),
        F.expr("CASE lang WHEN 'en' THEN 'AI' WHEN 'fr' THEN '芯片' WHEN 'de' THEN '机器人' ELSE 'other' END")
        .alias("domain"),
        headline.alias("title"),
        F.substring("text", 1, 2000).alias("description"),
        F.when(F.col("doc_id") % 29 > 0,
               F.timestamp_seconds(F.lit(int(SETTINGS.as_of.timestamp())) - (F.col("doc_id") * 7) % 48 * 3600))
        .alias("published_at"),
        F.expr("concat('PT', doc_id % 17, 'M', doc_id % 60, 'S')").alias("duration"),
        F.expr("CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'high' WHEN doc_id % 3 = 1 THEN 'medium' "
               "ELSE 'low' END").alias("authority"),
        F.expr("(coalesce(v, 0) * (doc_id % 13)) div 50").alias("views"),
        F.expr("(coalesce(l, 0) * (CASE WHEN doc_id % 11 < 4 THEN 4 ELSE 150 END) * (doc_id % 11)) div 1000")
        .alias("likes"),
        F.expr("(coalesce(c, 0) * 3 * (doc_id % 11)) div 100").alias("comments"),
        F.concat(F.lit("https://example.com/a/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Embeddings; of every three, one has a near-copy and one has two, which differ by a pattern of their ids."""
    rows = table(spark, folder, "embeddings").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("vec_id") % 3)))
    near = F.expr("transform(embedding, (x, i) -> CAST(x AS DOUBLE) + 0.01 * copy * ((vec_id * 31 + i * 17) % 7 - 3))")
    return rows.select((F.col("vec_id") + F.col("copy") * 1_000_000).alias("vec_id"), near.alias("embedding"))


def reactions(spark: SparkSession, folder: str) -> DataFrame:
    """Clicks as likes and errors as dislikes."""
    return (table(spark, folder, "events").where(F.col("event_type").isin("click", "error"))
            .transform(as_reactions))


def as_reactions(events: DataFrame) -> DataFrame:
    return events.where(F.col("event_type").isin("click", "error")).select(
        F.col("event_id").alias("event_ord"), F.col("ts").cast("timestamp").alias("ts"), "user_id",
        F.expr("concat('i', event_id % 40)").alias("item_id"),
        F.expr("CASE event_type WHEN 'click' THEN 'like' ELSE 'dislike' END").alias("reaction"),
        F.expr("concat('title ', event_id % 40, ' & more/é')").alias("title"),
        F.expr("CASE WHEN event_id % 13 = 0 THEN '' ELSE concat('src', event_id % 20) END").alias("channel"),
        F.expr("CASE event_id % 4 WHEN 0 THEN 'AI' WHEN 1 THEN '芯片' WHEN 2 THEN '机器人' ELSE '' END")
        .alias("domain"))


def item_reactions(spark: SparkSession, folder: str) -> DataFrame:
    """Every event as a reaction to one of the items: clicks and views of even items as likes, all else as dislikes."""
    n = max(table(spark, folder, "documents").count(), 1)
    item = (F.col("event_id") * 37) % n
    liked = (F.col("event_type") == "click") | ((F.col("event_type") == "view") & (item % 2 == 0))
    return table(spark, folder, "events").select(F.col("event_id").alias("event_ord"), "user_id", item.cast("string").alias("item_id"),
                                                 F.when(liked, "like").otherwise("dislike").alias("reaction"))


def request_log(spark: SparkSession, folder: str) -> DataFrame:
    """The reactions as requested addresses; every tenth is broken in one of five ways."""
    way = F.expr("CASE WHEN event_ord % 10 = 0 THEN (event_ord div 10) % 5 ELSE -1 END")
    title = F.url_encode("title")
    address = (F.when(way == 0, F.concat(F.lit("/other?id="), "item_id", F.lit("&r="), "reaction"))
               .when(way == 1, F.concat(F.lit("/feedback?id=&r="), "reaction"))
               .when(way == 2, F.concat(F.lit("/feedback?id="), "item_id", F.lit("&r=maybe")))
               .when(way == 3, F.lit("/feedback"))
               .when(way == 4, F.concat(F.lit("/feedback?id=&id="), "item_id", F.lit("&r="), "reaction",
                                        F.lit("&t=100%zz#r=like")))
               .otherwise(F.concat(F.lit("/feedback?id="), "item_id", F.lit("&r="), "reaction", F.lit("&t="), title)))
    return reactions(spark, folder).select("event_ord", "ts", "user_id", address.alias("url"))


def learned(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return feedback.learned_weights(reactions(spark, folder))


def scored(spark: SparkSession, folder: str, keep: tuple = ("brief_id", "ord", "item_id", "channel", "domain",
                                                           "title")) -> DataFrame:
    out = score_items(items(spark, folder), SETTINGS, per=("user_id",), keep=[*keep, "user_id"],
                      **learned(spark, folder))
    return out.drop("user_id")


def selected(spark: SparkSession, folder: str) -> DataFrame:
    return curate(items(spark, folder), SETTINGS, per=("user_id",), **learned(spark, folder))


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Generated answers: labelled, bare or missing."""
    title = F.substring_index(F.substring_index("text", "\n", 1), ". ", 1)
    raw = (F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("摘要： "), title, F.lit("\nWhy it matters：: "), "lang",
                                                    F.lit("  ")))
           .when(F.col("doc_id") % 3 == 1, title))
    return table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("item_id"), raw.alias("raw"))


def summarised(spark: SparkSession, folder: str) -> DataFrame:
    texts = items(spark, folder).select("brief_id", "ord", "description")
    picked = selected(spark, folder).join(texts, ["brief_id", "ord"])
    return briefing.attach_summaries(picked, responses(spark, folder))


def totals(spark: SparkSession, folder: str) -> DataFrame:
    return items(spark, folder).groupBy("brief_id").agg(F.count("*").alias("collected"))


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return brief(items(spark, folder), SETTINGS, responses(spark, folder), per=("user_id",),
                 **learned(spark, folder)).documents
