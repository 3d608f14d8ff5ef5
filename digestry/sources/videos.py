"""Landed responses of the video service."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from digestry import rules, schema
from digestry.functions import text as X
from digestry.settings import Settings


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (payload, landed): one response per line, and the file's time and path."""
    landed = F.concat_ws(" ", F.col("_metadata.file_modification_time").cast("string"), F.col("_metadata.file_path"))
    return spark.read.text(path).select(F.col("value").alias("payload"), landed.alias("landed"))


def parse_payloads(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Responses as structures, with `landed` if the rows have it. Lines that are not JSON give empty responses; see
    `payload_rejects`."""
    landed = ["landed"] if "landed" in raw.columns else []
    return raw.select(F.from_json(column, schema.VIDEO_PAYLOAD).alias("_p"), *landed).select("_p.*", *landed)


def payload_rejects(raw: DataFrame, column: str = "payload") -> DataFrame:
    """Rows that are no JSON object, as they landed; empty lines are none."""
    columns = T.StructType([*schema.VIDEO_PAYLOAD.fields, T.StructField("_unread", T.StringType())])
    read = F.from_json(column, columns, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_unread"})
    return raw.where(F.trim(column) != "").withColumn("_r", read).where(F.col("_r._unread").isNotNull() | F.col("_r").isNull()).drop("_r")


def _count(value: Column) -> Column:
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def flatten_payloads(payloads: DataFrame) -> DataFrame:
    """One item row per video, with `landed` if the responses have it."""
    v = F.col("_v")
    landed = ["landed"] if "landed" in payloads.columns else []
    return (payloads.select(F.explode("items").alias("_v"), *landed)
            .select(*landed, v["id"].alias("item_id"), F.lit("YouTube").alias("kind"),
                    v["snippet"]["channelId"].alias("channel_id"), v["snippet"]["channelTitle"].alias("channel"),
                    v["snippet"]["title"].alias("title"),
                    F.substring(X.text_or_empty(v["snippet"]["description"]), 1, rules.DESCRIPTION_CHARS)
                    .alias("description"),
                    F.try_to_timestamp(v["snippet"]["publishedAt"]).alias("published_at"),
                    _count(v["statistics"]["viewCount"]).alias("views"),
                    _count(v["statistics"]["likeCount"]).alias("likes"),
                    _count(v["statistics"]["commentCount"]).alias("comments"),
                    v["contentDetails"]["duration"].alias("duration"),
                    F.concat(F.lit("https://youtube.com/watch?v="), v["id"]).alias("url")))


def _since(as_of: datetime) -> Column:
    return F.lit(as_of - timedelta(days=1))


def latest_of_channels(uploads: DataFrame, s: Settings, channel: str = "channel_id") -> DataFrame:
    """Newest uploads of each subscribed channel, then those of the last day; the channel sets the domain.

    The subscription list is configuration, hence a mapping in the plan. Spark also applies the limit per channel
    before the shuffle, so a channel with most of the uploads sends only a few rows.
    """
    if not s.channels:
        return uploads.where(F.lit(False)).withColumns({"domain": F.lit(""), "place": F.lit(0).cast("bigint"),
                                                        "channel_ord": F.lit(0).cast("bigint")})
    names = [c for c, _ in s.channels]
    at = F.array_position(F.array(*[F.lit(c) for c in names]), F.col(channel)) - 1
    domain = F.get(F.array(*[F.lit(d) for _, d in s.channels]), at.cast("int"))
    newest = Window.partitionBy(channel).orderBy(F.col("published_at").desc(), F.col("ord"))
    return (uploads.where(F.col(channel).isin(names))
            .withColumn("place", F.row_number().over(newest).cast("bigint"))
            .where(F.col("place") <= rules.UPLOADS_PER_CHANNEL)
            .where(F.date_trunc("second", "published_at") >= F.date_trunc("second", _since(s.as_of)))
            .withColumns({"domain": domain, "channel_ord": at.cast("bigint")}))


def best_of_keywords(videos: DataFrame, s: Settings) -> DataFrame:
    """Best recent videos per search keyword, with the keyword's domain.

    Ordered by how often the keyword occurs, then newest, then ordinal. Only matching (video, keyword) rows are
    produced, by filtering the configured keywords inside the row.
    """
    words = [(d, k) for d, group in s.search_keywords for k in group if k]
    if not words:
        nothing = {"keyword": F.lit(""), "domain": F.lit(""), "keyword_ord": F.lit(0).cast("bigint"),
                   "occurrences": F.lit(0).cast("bigint"), "place": F.lit(0).cast("bigint")}
        return videos.where(F.lit(False)).withColumns(nothing)
    table = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(k.lower()).alias("_word"), F.lit(d).alias("domain"),
                               F.lit(i).cast("bigint").alias("keyword_ord")) for i, (d, k) in enumerate(words)])
    text = X.searchable(F.col("title"), F.col("description"))
    rest = [c for c in videos.columns if c != "domain"]
    matched = (videos.where(F.col("published_at") >= _since(s.as_of))
               .withColumn("_text", text)
               .withColumn("_hit", F.explode(X.once(F.col("_text"), lambda t: F.filter(table, lambda k: F.contains(t, k["_word"])))))
               .select(*rest, "_hit.keyword", "_hit.keyword_ord", "_hit.domain",
                       X.occurrences(F.col("_text"), F.col("_hit._word")).alias("occurrences")))
    best = (Window.partitionBy("keyword_ord")
            .orderBy(F.col("occurrences").desc(), F.col("published_at").desc(), F.col("ord")))
    return (matched.withColumn("place", F.row_number().over(best).cast("bigint"))
            .where(F.col("place") <= rules.RESULTS_PER_KEYWORD))


def first_per_id(rows: DataFrame, ordinal: str = "ord", key: str = "item_id") -> DataFrame:
    """First row of each id. The limit of one also applies before the shuffle, so many copies cost little."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(ordinal))
    return rows.withColumn("_n", place).where(F.col("_n") == 1).drop("_n")


def collected(sources: Sequence[DataFrame], ordinal: str = "ord") -> DataFrame:
    """Union of sources, earlier ones first: `source_no`, then the ordinal within the source."""
    out = None
    for number, rows in enumerate(sources):
        rows = rows.withColumn("source_no", F.lit(number).cast("bigint"))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def transcripts(snippets: DataFrame, key: str = "video_id", lang: str = "lang", position: str = "pos",
                text: str = "text") -> DataFrame:
    """Transcript per video: best language, its first snippets in order, cut to length.

    At most 200 snippets per video and language are ever brought together; the limit also applies before the
    shuffle.
    """
    rank = F.array_position(F.array(*[F.lit(code) for code in rules.TRANSCRIPT_LANGUAGES]), F.col(lang))
    place = F.row_number().over(Window.partitionBy(key, "_lang").orderBy(position))
    parts = (snippets.select(key, position, text, rank.alias("_lang")).where(F.col("_lang") > 0)
             .withColumn("_n", place).where(F.col("_n") <= rules.TRANSCRIPT_SNIPPETS)
             .groupBy(key, "_lang").agg(F.array_sort(F.collect_list(F.struct("_n", text))).alias("_parts")))
    joined = F.array_join(F.transform("_parts", lambda p: p[text]), " ")
    best = parts.groupBy(key).agg(F.min(F.struct("_lang", F.substring(joined, 1, rules.TRANSCRIPT_CHARS)
                                                 .alias("transcript"))).alias("_best"))
    return best.select(key, F.col("_best.transcript").alias("transcript"))


def with_transcripts(videos: DataFrame, texts: DataFrame, key: str = "video_id") -> DataFrame:
    return (videos.join(texts, key, "left")
            .withColumn("transcript", F.coalesce("transcript", F.lit(""))))


def simplified(items: DataFrame, table: tuple[str, str], columns: Sequence[str],
               only_lang: str | None = None) -> DataFrame:
    """Map characters of text columns by a given table, for one language or all."""
    return items.withColumns({c: X.simplify_script(F.col(c), F.col("lang") if only_lang else F.lit(None),
                                                   only_lang, table) for c in columns})
