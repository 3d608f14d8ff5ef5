"""Landed feed documents (RSS or Atom), one file per feed and fetch."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry import rules, schema
from digestry.functions import text as X
from digestry.operators.classify import classify
from digestry.settings import Settings
from digestry.sources.videos import simplified

_ENTRY = ("STRUCT<id: STRING, link: STRING, title: STRING, body: STRING, published: STRING, updated: STRING>")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as (feed_name, fetch, content); the file name without extension names the feed, and the file's time
    and path are the fetch, which orders several documents of one feed.

    The name comes percent-encoded from the file source.
    """
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1)
    return (spark.read.text(path, wholetext=True)
            .select(F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))).alias("feed_name"),
                    F.concat_ws(" ", F.col("_metadata.file_modification_time").cast("string"), "_metadata.file_path").alias("fetch"),
                    F.col("value").alias("content")))


# Hours from UTC of the zone names that mail dates use.
_ZONES = {"GMT": 0, "UTC": 0, "UT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7}

_MAIL_DATE = r"^(\d{1,2} [A-Za-z]{3}) (\d{4}|\d\d) (\d{1,2}:\d\d)(:\d\d)?(?:\s+(\S+))?$"


def parse_time(value: Column) -> Column:
    """ISO-8601 or RFC-822 time, else NULL: with or without weekday, seconds and zone, years of two or four digits.

    Zone names count as their offset, a missing zone as UTC.
    """
    offsets = F.create_map(*[F.lit(x) for name, hours in _ZONES.items() for x in (name, f"{hours:+03d}00")])

    def mail_time(bare: Column) -> Column:
        """Day, month, year, time and offset, each found once."""
        part = lambda n: F.regexp_extract(bare, _MAIL_DATE, n)
        year = F.when(F.length(part(2)) == 4, part(2)).when(part(2) >= "70", F.concat(F.lit("19"), part(2))).otherwise(F.concat(F.lit("20"), part(2)))
        time = F.when(part(4) != "", F.concat(part(3), part(4))).otherwise(F.concat(part(3), F.lit(":00")))
        zone = F.when(part(5) == "", F.lit("+0000")).otherwise(F.coalesce(F.try_element_at(offsets, part(5)), part(5)))
        return F.try_to_timestamp(F.concat_ws(" ", part(1), year, time, zone), F.lit("d MMM yyyy HH:mm:ss Z"))

    bare = F.trim(F.regexp_replace(value, r"^\s*[A-Za-z]{3,9},\s*", ""))
    mail = F.when(value.rlike(r"^\s*[A-Za-z]{3,9},|^\s*\d{1,2} "), X.once(bare, mail_time))
    return F.coalesce(mail, F.try_to_timestamp(value))


def _parsed(content: Column) -> Column:
    """The document; if it is not well-formed, what it gives once stray `&` outside CDATA are escaped."""
    read = lambda text: F.from_xml(text, schema.FEED_DOCUMENT, {"columnNameOfCorruptRecord": "_unread"})
    stray = r"(?s)&(?!(?:amp|lt|gt|quot|apos|#\d+|#[xX][0-9A-Fa-f]+);)(?!(?:(?!<!\[CDATA\[).)*?\]\]>)"
    return X.once(read(content), lambda first: F.when(first["_unread"].isNull(), first).otherwise(
        read(F.regexp_replace(content, stray, "&amp;"))))


def feed_rejects(documents: DataFrame) -> DataFrame:
    """Documents that give no entries because they cannot be read even after repair; same columns as `documents`."""
    doc = F.col("_doc")
    return (documents.withColumn("_doc", _parsed(F.col("content")))
            .where(doc.isNull() | doc["_unread"].isNotNull()).drop("_doc"))


def _entries(doc: Column) -> Column:
    rss = F.transform(doc["channel"]["item"], lambda e: F.struct(
        e["guid"].alias("id"), e["link"].alias("link"), e["title"].alias("title"), F.coalesce(e["description"], e["content:encoded"]).alias("body"),
        e["pubDate"].alias("published"), F.coalesce(e["updated"], e["dc:date"]).alias("updated")).cast(_ENTRY))

    def atom_link(links: Column) -> Column:
        main = F.filter(links, lambda k: F.coalesce(k["_rel"], F.lit("alternate")) == "alternate")
        return F.coalesce(F.get(main, F.lit(0)), F.get(links, F.lit(0)))["_href"]

    atom = F.transform(doc["entry"], lambda e: F.struct(
        e["id"].alias("id"), atom_link(e["link"]).alias("link"), e["title"].alias("title"),
        F.coalesce(e["summary"], e["content"]).alias("body"), e["published"].alias("published"), e["updated"].alias("updated")).cast(_ENTRY))
    return F.coalesce(rss, atom)


def feed_entries(documents: DataFrame, s: Settings, feeds: DataFrame,
                 script_table: tuple[str, str] | None = None) -> DataFrame:
    """Articles of configured feeds: first 20 entries of a document, then those of the last day or without time.

    `feeds` holds one row per feed name (name, lang, domains, authority, ord). Domains are set by `classify`, after
    characters of Chinese feeds are mapped by the given table.
    """
    fetch = F.col("fetch") if "fetch" in documents.columns else F.lit("").alias("fetch")
    parsed = (documents.select("feed_name", fetch, _parsed(F.col("content")).alias("_doc"))
              .select("feed_name", "fetch", F.posexplode(F.slice(_entries(F.col("_doc")), 1, rules.ENTRIES_PER_FEED))
                      .alias("entry_no", "_e")))
    e = F.col("_e")
    rows = (parsed.withColumn("published_at", F.coalesce(parse_time(e["published"]), parse_time(e["updated"])))
            .where(F.col("published_at").isNull() | (F.col("published_at") >= F.lit(s.as_of - timedelta(days=1))))
            .select("feed_name", "fetch", F.col("entry_no").cast("bigint").alias("entry_no"),
                    F.coalesce(e["id"], e["link"]).alias("item_id"),
                    F.lit("RSS").alias("kind"), F.coalesce(e["title"], F.lit("")).alias("title"),
                    F.substring(X.strip_tags(F.coalesce(e["body"], F.lit(""))), 1, rules.DESCRIPTION_CHARS)
                    .alias("description"),
                    "published_at", F.coalesce(e["link"], F.lit("")).alias("url")))
    config = feeds.select(F.col("name").alias("feed_name"), "lang", "domains",
                          F.coalesce("authority", F.lit("medium")).alias("authority"),
                          F.col("ord").cast("bigint").alias("feed_ord"))
    rows = rows.join(config, "feed_name")
    if script_table:
        rows = simplified(rows, script_table, ("title", "description"), "zh")
    rows = rows.withColumn("item_id", F.coalesce("item_id", "title"))
    if "fetch" not in documents.columns:
        rows = rows.drop("fetch")
    return (classify(rows, s)
            .withColumnRenamed("feed_name", "channel")
            .withColumns({"views": F.lit(0).cast("bigint"), "likes": F.lit(0).cast("bigint"),
                          "comments": F.lit(0).cast("bigint"), "duration": F.lit(""), "transcript": F.lit("")})
            .drop("domains"))


def feeds_without_domains(feeds: DataFrame) -> DataFrame:
    """Feeds whose entries are dropped because no domain is allowed for them."""
    return feeds.where(F.coalesce(F.size("domains"), F.lit(0)) <= 0)
