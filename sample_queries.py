"""One query per operator over the driver's test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import sample_views as V
from digestry.functions import scores as S
from digestry.functions import text as X
from digestry.operators import briefing, card, feedback, learning, ranking, scoring, selection, titles, trends, vectors
from digestry.operators.classify import classify
from digestry.plans.curate import curate as curated
from digestry.plans.curate import funnel
from digestry.session import scratch_path
from digestry.sources import feeds, tables, videos
from digestry.streaming import alerts as alert
from digestry.streaming import reactions as stream

P = V.SETTINGS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _epoch(column: str):
    return F.unix_timestamp(column).cast("bigint").alias(column)


def _utc_text(column: str, pattern: str):
    return F.date_format(F.to_utc_timestamp(column, F.current_timezone()), pattern)


# --- Sources -----------------------------------------------------------------------------------------------------

@query
def ingest_flatten(spark, folder):
    docs = V.items(spark, folder).select("item_id", "channel", "title", "description", "views", "likes", "comments",
                                         "duration", "published_at", "ord")
    payload = F.to_json(F.struct(F.array(F.struct(
        F.col("item_id").alias("id"),
        F.struct("title", F.col("channel").alias("channelTitle"), "description",
                 F.concat(_utc_text("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("publishedAt"))
        .alias("snippet"),
        F.when(F.col("ord") % 5 > 0, F.struct(F.col("views").cast("string").alias("viewCount"),
                                              F.when(F.col("ord") % 4 > 0, F.col("likes").cast("string"))
                                              .alias("likeCount"),
                                              F.col("comments").cast("string").alias("commentCount")))
        .alias("statistics"),
        F.struct("duration").alias("contentDetails"))).alias("items")))
    rows = videos.flatten_payloads(videos.parse_payloads(docs.select(payload.alias("payload"))))
    return rows.withColumn("published_at", _epoch("published_at")).drop("channel_id")


@query
def latest_per_channel(spark, folder):
    rows = videos.latest_of_channels(V.items(spark, folder).select("item_id", "ord", "channel", "published_at"),
                                     P, "channel")
    return rows.select("channel", "item_id", "ord", "domain", _epoch("published_at"))


@query
def keyword_topk(spark, folder):
    rows = videos.best_of_keywords(
        V.items(spark, folder).select("item_id", "ord", "title", "description", "published_at"), P)
    return rows.select("keyword", "domain", "place", "item_id", "occurrences")


def _subscribed_and_found(spark, folder):
    base = V.items(spark, folder).select("item_id", "ord", "channel", "title", "description", "published_at")
    subscribed = videos.latest_of_channels(base, P, "channel").select(
        "item_id", "domain", F.struct(F.lit(0).cast("bigint").alias("mode"), F.lit(0).cast("bigint").alias("keyword"),
                                      F.col("ord").alias("ord")).alias("ord"))
    found = videos.best_of_keywords(base, P).select(
        "item_id", "domain", F.struct(F.lit(1).cast("bigint").alias("mode"), F.col("keyword_ord").alias("keyword"),
                                      F.col("place").alias("ord")).alias("ord"))
    return subscribed.unionByName(found)


@query
def first_by_id(spark, folder):
    rows = videos.first_per_id(_subscribed_and_found(spark, folder))
    return rows.select("item_id", "domain", F.col("ord.mode").alias("mode"))


@query
def transcript_join(spark, folder):
    snippets = V.table(spark, folder, "conversations").select(
        F.col("conv_id").alias("video_id"),
        F.expr("CASE role WHEN 'user' THEN CASE WHEN conv_id % 3 = 0 THEN 'de' ELSE 'zh' END "
               "WHEN 'assistant' THEN CASE WHEN conv_id % 2 = 0 THEN 'en' ELSE 'zh-Hans' END ELSE 'fr' END")
        .alias("lang"), F.col("turn").alias("pos"), "text")
    calls = V.table(spark, folder, "conversations").select(F.col("conv_id").alias("video_id")).distinct()
    return videos.with_transcripts(calls, videos.transcripts(snippets))


def _feed_files(spark, folder):
    """Feed documents put together from the items: one per channel and 500 items, hence of bounded size."""

    def escaped(value):
        for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            value = F.replace(value, F.lit(char), F.lit(entity))
        return value

    rows = V.items(spark, folder)
    rfc = F.concat(_utc_text("published_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))
    entry = F.concat(
        F.lit("<item>"),
        F.when(F.col("ord") % 3 > 0, F.concat(F.lit('<guid isPermaLink="false">g'), "item_id", F.lit("</guid>")))
        .otherwise(""),
        F.when(F.col("ord") % 6 > 0, F.concat(F.lit("<link>"), "url", F.lit("</link>"))).otherwise(""),
        F.lit("<title>"), escaped(_plain(F.col("title"))), F.lit("</title><description>"),
        escaped(F.concat(F.lit("<p>x</p> "), _plain(F.col("description")))), F.lit("</description>"),
        F.coalesce(F.concat(F.lit("<pubDate>"), rfc, F.lit("</pubDate>")), F.lit("")), F.lit("</item>"))
    listed = rows.groupBy("channel", F.expr("ord div 500").alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("ord", entry.alias("xml")))).alias("e"))
    body = F.array_join(F.transform("e", lambda e: e["xml"]), "")
    return listed.select(F.concat("channel", F.lit("/"), F.col("block").cast("string")).alias("feed_name"),
                         F.concat(F.lit("<rss><channel><title>t</title>"), body, F.lit("</channel></rss>"))
                         .alias("content"))


def _plain(value):
    """Text that XML can carry unchanged."""
    return F.trim(F.regexp_replace(F.regexp_replace(value, r"[^\x20-\x7E\x{A1}-\x{D7FF}]+", " "), "<", "("))


def _feed_rules(names):
    return names.select(
        F.col("feed_name").alias("name"), F.lit("en").alias("lang"),
        F.expr("CASE length(feed_name) % 3 WHEN 0 THEN array('AI', '芯片', '机器人') WHEN 1 THEN array('机器人', 'AI') "
               "ELSE array('芯片') END").alias("domains"), F.lit("high").alias("authority"), F.lit(0).alias("ord"))


@query
def feed_entries(spark, folder):
    files = _feed_files(spark, folder)
    rows = feeds.feed_entries(files, P, _feed_rules(files.select("feed_name")))
    return rows.select("channel", "entry_no", "item_id", "title", "description", "domain", "url", "authority",
                       _epoch("published_at"))


@query
def rule_tables(spark, folder):
    """Rule tables from the documents: some whole, one with a broken file, one broken, the others missing; and how many
    documents the channels that were read give a domain."""
    path = scratch_path(spark, "rules")
    docs = V.table(spark, folder, "documents")
    sources = docs.groupBy("source").agg(F.min("lang").alias("lang"), F.min("doc_id").cast("int").alias("ord"))
    sources.select(F.col("source").alias("channel_id"), F.col("lang").alias("domain"), "ord").write.parquet(f"{path}/channels")
    sources.select(F.col("source").alias("channel")).coalesce(1).write.parquet(f"{path}/whitelist")
    docs.groupBy("lang").agg(F.lit("no table").alias("value")).select("value").coalesce(1).write.mode("append").text(f"{path}/whitelist")
    sources.select("source").coalesce(1).write.text(f"{path}/spam_keywords")
    read = tables.settings_from_tables(spark, path, P)
    unread = {r["name"]: r["n"] for r in tables.unread_rules(spark, path).groupBy("name").agg(F.count("*").alias("n")).collect()}
    rules = {"channels": read.channels, "whitelist": read.whitelist, "spam_keywords": read.spam_keywords, "feeds": read.feeds, "domains": read.domains}
    found = spark.createDataFrame([(n, len(r), unread.get(n, 0)) for n, r in rules.items()], "name string, rules bigint, unread bigint")
    known = videos.latest_of_channels(V.items(spark, folder).select("item_id", "ord", "channel", "published_at"), read, "channel")
    return found.unionByName(known.groupBy("domain").agg(F.count("*").alias("rules")).select(F.concat(F.lit("videos of "), "domain").alias("name"), "rules", F.lit(0).cast("bigint").alias("unread")))


@query
def strip_tags(spark, folder):
    return V.table(spark, folder, "pages").select(
        "page_id", F.substring(X.strip_tags(F.col("html")), 1, 2000).alias("body"))


@query
def script_normalised(spark, folder):
    rows = V.table(spark, folder, "documents").select("doc_id", "lang", "text")
    return videos.simplified(rows, ("äöüéè", "aouee"), ["text"], "de").select("doc_id", "text")


@query
def multi_source_union(spark, folder):
    rows = V.items(spark, folder).select("item_id", "ord", "kind", "authority", "duration")
    out = videos.collected([rows.where(F.col("kind") == "YouTube").drop("authority"),
                            rows.where(F.col("kind") == "RSS").drop("duration")])
    return out.select("source_no", "ord", "item_id", "kind", "authority", "duration")


# --- Enrichment and scores ---------------------------------------------------------------------------------------

@query
def classify_domain(spark, folder):
    rows = V.items(spark, folder).withColumn("domains", F.expr(
        "CASE ord % 5 WHEN 0 THEN array('芯片', 'AI') WHEN 1 THEN array('AI', '芯片', '机器人') "
        "WHEN 2 THEN array('机器人') WHEN 3 THEN array('机器人', 'AI') ELSE array('AI', '芯片', '机器人') END"))
    return classify(rows, P).select("item_id", "domain")


@query
def keyword_hits(spark, folder):
    text = X.searchable(F.col("title"), F.col("description"))
    return V.items(spark, folder).select("item_id", X.keyword_hits(text, P.all_keywords).cast("bigint").alias("hits"))


def _component(name):
    def build(spark, folder):
        points = scoring.base_components(P)[name].cast("bigint")
        return V.items(spark, folder).select("item_id", points.alias("points"))
    return build


for _key, _name in (("score_credibility", "credibility"), ("score_length", "length"),
                    ("score_engagement", "engagement"), ("score_relevance", "relevance"),
                    ("score_recency", "recency"), ("score_spam", "spam")):
    QUERIES[_key] = _component(_name)


@query
def duration_minutes(spark, folder):
    return V.items(spark, folder).select(
        "item_id", X.duration_seconds(F.col("duration")).alias("seconds"),
        X.duration_label(F.col("duration")).alias("label"))


@query
def tracking_links(spark, folder):
    return V.table(spark, folder, "pages").select("page_id", S.tracked_link(F.col("url")).alias("tracked"))


@query
def score_feedback(spark, folder):
    rows = V.items(spark, folder).select("item_id", "user_id", "channel", "domain")
    out = scoring.with_preferences(rows, per=("user_id",), **V.learned(spark, folder))
    return out.select("item_id", F.col("preference").alias("points"))


@query
def quality_score(spark, folder):
    return V.scored(spark, folder).select(*V.KEYS_AND_SCORE)


# --- Selection ---------------------------------------------------------------------------------------------------

@query
def threshold_filter(spark, folder):
    return ranking.passing(V.scored(spark, folder), P).select(*V.KEYS_AND_SCORE)


@query
def threshold_fallback(spark, folder):
    high = P.with_(threshold=70, fallback_threshold=40)
    return ranking.passing_with_fallback(V.scored(spark, folder), high).select(*V.KEYS_AND_SCORE, "threshold_used")


@query
def ranked_items(spark, folder):
    rows = ranking.passing(V.scored(spark, folder), P).select(*V.KEYS_AND_SCORE)
    sizes = V.items(spark, folder).select("brief_id", "ord")
    return ranking.ranked(rows, P, sizes_from=sizes).withColumn("rank", F.col("rank").cast("bigint"))


@query
def title_tokens(spark, folder):
    words = F.array_join(F.array_sort(X.title_tokens(F.col("title"))), " ")
    return V.items(spark, folder).select("item_id", words.alias("words"))


def _titled(spark, folder):
    return ranking.passing(V.scored(spark, folder), P)


@query
def similar_title_pairs(spark, folder):
    return titles.title_matches(_titled(spark, folder), P)


@query
def dedup_titles(spark, folder):
    return titles.drop_similar_titles(_titled(spark, folder), P).select(*V.KEYS_AND_SCORE)


@query
def capped_topk(spark, folder):
    return selection.select_top(_titled(spark, folder), P).select(*V.KEYS_AND_SCORE, "pick")


@query
def funnel_counts(spark, folder):
    return funnel(V.scored(spark, folder), P)


@query
def curate(spark, folder):
    return V.selected(spark, folder).select(*V.KEYS_AND_SCORE, "channel", "domain", "title", "pick")


@query
def embedding_pairs(spark, folder):
    return vectors.drop_close(V.vectors(spark, folder), P)


# --- Reactions ---------------------------------------------------------------------------------------------------

@query
def latest_reaction(spark, folder):
    return feedback.latest_reactions(V.reactions(spark, folder).drop("ts"))


def _weights(events, key):
    return feedback.weights(events, key).withColumn("weight", F.col("weight").cast("bigint"))


@query
def source_weights(spark, folder):
    return _weights(V.reactions(spark, folder), "channel")


@query
def domain_weights(spark, folder):
    return _weights(V.reactions(spark, folder), "domain")


@query
def preference_weights(spark, folder):
    return feedback.weights_by(V.reactions(spark, folder)).withColumn("weight", F.col("weight").cast("bigint"))


@query
def feedback_stats(spark, folder):
    return feedback.reaction_stats(V.reactions(spark, folder))


@query
def feedback_from_log(spark, folder):
    return feedback.from_request_log(V.request_log(spark, folder)).drop("ts")


@query
def parse_briefing(spark, folder):
    return feedback.parse_briefings(V.documents(spark, folder), P)


@query
def reaction_join(spark, folder):
    votes = V.reactions(spark, folder).select(
        "event_ord", F.col("user_id").alias("brief_id"), (F.col("event_ord") % 10).alias("number"), "reaction")
    return feedback.reactions_by_number(votes, feedback.parse_briefings(V.documents(spark, folder), P))


@query
def stream_weights(spark, folder):
    layout = V.table(spark, folder, "events").schema
    log = stream.read_log(spark, f"{folder}/events.parque[t]", layout)
    path, checkpoint = scratch_path(spark, "weights"), scratch_path(spark, "weights-progress")
    stream.maintain_weights(V.as_reactions(log), "channel", path, checkpoint).awaitTermination()
    return stream.current_weights(spark, path, "channel").withColumn("weight", F.col("weight").cast("bigint"))


@query
def stream_latest(spark, folder):
    layout = V.table(spark, folder, "events").schema
    log = stream.read_log(spark, f"{folder}/events.parque[t]", layout)
    path, checkpoint = scratch_path(spark, "latest"), scratch_path(spark, "latest-progress")
    stream.maintain_latest(V.as_reactions(log).drop("ts"), path, checkpoint).awaitTermination()
    return stream.current_latest(spark, path)


@query
def stream_alerts(spark, folder):
    """Items land one to three times, minutes apart; each major one is one alert."""
    layout = V.table(spark, folder, "documents").schema
    landed = V.items(spark, folder, stream.read_log(spark, f"{folder}/documents.parque[t]", layout))
    copies = landed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("ord") % 3))).withColumn(
        "landed_at", F.lit(P.as_of) + F.make_dt_interval(mins=F.col("copy").cast("int") * 10))
    found = alert.alerts(copies, P, at_least=55, keep=("title", "channel", "domain"), per=("user_id",), **V.learned(spark, folder))
    path = scratch_path(spark, "alerts")
    alert.follow(found, path, scratch_path(spark, "alerts-progress")).awaitTermination()
    return alert.sent(spark, path).select("brief_id", "item_id", "title", "channel", "domain", "quality_score")


# --- Briefing ----------------------------------------------------------------------------------------------------

@query
def attach_summaries(spark, folder):
    rows = briefing.attach_summaries(V.items(spark, folder).select("item_id", "description"),
                                     V.responses(spark, folder))
    return rows.select("item_id", "summary", "why_it_matters")


@query
def parse_responses(spark, folder):
    summary, why = X.parse_response(F.col("raw"))
    return (V.responses(spark, folder).where(F.col("raw").isNotNull())
            .select("item_id", summary.alias("summary"), why.alias("why_it_matters")))


@query
def prompt_table(spark, folder):
    rows = V.items(spark, folder).withColumn("transcript", F.lit(None).cast("string"))
    return briefing.item_prompts(rows).select("item_id", "prompt")


@query
def trend_prompts(spark, folder):
    return briefing.trend_prompts(V.summarised(spark, folder))


@query
def briefing_sections(spark, folder):
    return briefing.sections(V.selected(spark, folder), P).select("brief_id", "item_id", "domain", "domain_ord",
                                                                  "number", "domain_count")


@query
def source_lines(spark, folder):
    return V.items(spark, folder).select(
        "item_id", briefing.source_line(F.col("kind"), F.col("channel"), F.col("duration")).alias("source_line"),
        briefing.link_label(F.col("kind")).alias("link_label"))


@query
def selection_rate(spark, folder):
    picked = V.selected(spark, folder).groupBy("brief_id").agg(F.count("*").alias("selected"))
    counts = V.totals(spark, folder).join(picked, "brief_id", "left").fillna(0, ["selected"])
    return briefing.with_rate(counts)


@query
def briefing_lines(spark, folder):
    return briefing.document_lines(V.documents(spark, folder))


@query
def briefing_doc(spark, folder):
    return V.documents(spark, folder)


@query
def briefing_sink(spark, folder):
    path = scratch_path(spark, "briefings")
    day = F.lit(f"{P.as_of:%Y-%m-%d}")
    tables.write_briefings(V.documents(spark, folder).withColumn("brief_date", day), path)
    return spark.read.parquet(path).select("brief_id", "md", F.col("brief_date").cast("string").alias("brief_date"))


@query
def card_elements(spark, folder):
    return card.card_elements(V.documents(spark, folder), P)


@query
def card_payload_sink(spark, folder):
    path = scratch_path(spark, "cards")
    tables.write_payloads(card.payloads(V.documents(spark, folder), P), path)
    layout = ("msg_type STRING, card STRUCT<header: STRUCT<title: STRUCT<content: STRING>, template: STRING>, "
              "elements: ARRAY<STRUCT<tag: STRING>>>")
    return spark.read.schema(layout).json(path).select(
        "msg_type", F.col("card.header.title.content").alias("title"), F.col("card.header.template").alias("template"),
        F.size("card.elements").cast("bigint").alias("elements"))


@query
def reaction_links(spark, folder):
    return card.reaction_links(V.documents(spark, folder), P)


@query
def reaction_store(spark, folder):
    path = scratch_path(spark, "reactions")
    tables.append_reactions(V.reactions(spark, folder), path)
    good, _ = tables.read_reactions(spark, path)
    return good.drop("ts")


# --- Landed data with flaws, and large briefings -----------------------------------------------------------------

@query
def landed_rejects(spark, folder):
    """Every seventh response is cut off, every eleventh feed document has an open element."""
    docs = V.table(spark, folder, "documents").select("doc_id")
    line = F.to_json(F.struct(F.array(F.struct(F.col("doc_id").cast("string").alias("id"))).alias("items")))
    cut = F.expr("substring(line, 1, length(line) - 3)")
    lines = docs.withColumn("line", line).withColumn("payload", F.when(F.col("doc_id") % 7 == 0, cut).otherwise(F.col("line")))
    files = docs.withColumn("content", F.concat(
        F.lit("<rss><channel><item><title>A & B"), F.when(F.col("doc_id") % 11 == 0, "").otherwise("</title>"), F.lit("</item></channel></rss>")))
    return (videos.payload_rejects(lines).select(F.lit("payload").alias("kind"), "doc_id")
            .unionByName(feeds.feed_rejects(files).select(F.lit("feed").alias("kind"), "doc_id")))


@query
def feed_forms(spark, folder):
    """RSS with encoded content and mail dates, Atom with content, RSS with stray `&` and Dublin Core dates."""
    docs = V.table(spark, folder, "documents").select("doc_id", F.col("doc_id").cast("string").alias("id"))
    space = ' xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/"'
    encoded = F.concat(F.lit(f"<rss{space}><channel><item><guid>g"), "id", F.lit("</guid><title>T"), "id", F.lit("</title><content:encoded><![CDATA[<p>body & "), "id",
                       F.lit("</p>]]></content:encoded><pubDate>Tue, 30 Jan 24 22:15 EST</pubDate></item></channel></rss>"))
    atom = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>g'), "id", F.lit("</id><title>T"), "id", F.lit('</title><content type="html">&lt;p&gt;body &amp; '), "id",
                    F.lit("&lt;/p&gt;</content><updated>2024-01-30T22:15:00Z</updated></entry></feed>"))
    stray = F.concat(F.lit(f"<rss{space}><channel><item><guid>g"), "id", F.lit("</guid><title>T"), "id", F.lit("</title><description>body & "), "id",
                     F.lit("</description><dc:date>2024-01-30T22:15:00+01:00</dc:date></item></channel></rss>"))
    files = docs.select(F.col("id").alias("feed_name"), F.when(F.col("doc_id") % 3 == 0, encoded).when(F.col("doc_id") % 3 == 1, atom).otherwise(stray).alias("content"))
    return feeds.feed_entries(files, P, _feed_rules(files.select("feed_name"))).select("item_id", "title", "description", _epoch("published_at"))


def _by_language(rows):
    return rows.withColumn("brief_id", F.expr("CASE domain WHEN 'AI' THEN 0 WHEN '芯片' THEN 1 WHEN '机器人' THEN 2 ELSE 3 END").cast("bigint"))


def _large(spark, folder):
    """Four large briefings, one per language, with all that passes."""
    return _by_language(ranking.passing(V.scored(spark, folder), P))


@query
def ranked_large(spark, folder):
    rows = _large(spark, folder).select(*V.KEYS_AND_SCORE)
    return ranking.ranked(rows, P).withColumn("rank", F.col("rank").cast("bigint"))


@query
def dedup_titles_large(spark, folder):
    return titles.drop_similar_titles(_large(spark, folder), P).select(*V.KEYS_AND_SCORE)


@query
def curate_large(spark, folder):
    items = _by_language(V.items(spark, folder))
    picks = curated(items, P, per=("user_id",), **V.learned(spark, folder))
    return picks.select(*V.KEYS_AND_SCORE, "channel", "domain", "title", "pick")


# --- Preferences and terms ---------------------------------------------------------------------------------------

KEYWORDS = P.with_(domain_keywords=(("AI", ("title 1", "more", "É")), ("芯片", ("title 2", "more")), ("机器人", ("nothing",))))


@query
def keyword_weights(spark, folder):
    found = feedback.keyword_weights(V.reactions(spark, folder), KEYWORDS)
    return found.withColumn("weight", F.col("weight").cast("bigint"))


@query
def preference_examples(spark, folder):
    return feedback.preference_examples(V.reactions(spark, folder))


@query
def quality_model(spark, folder):
    items = V.items(spark, folder)
    good = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)
    labels = V.table(spark, folder, "labels").select(F.col("doc_id").cast("string").alias("item_id"), good.alias("label"))
    model = learning.learn_quality(items, labels, P)
    return model.score(items, P).withColumn("held_out", learning.held_out(F.col("item_id")))


@query
def learning_to_rank(spark, folder):
    items = V.items(spark, folder)
    return learning.learn_ranking(V.item_reactions(spark, folder), items, P).score(items, P, ["brief_id", "item_id"])


@query
def emerging_terms(spark, folder):
    return trends.emerging_terms(V.items(spark, folder), hours=12)
