"""Reactions of readers and the preferences learned from them.

Reactions are an append-only table; both views of it (latest reaction per item, weights) are derived.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.functions import text as X
from digestry.settings import Settings


def latest_reactions(events: DataFrame, per: Sequence[str] = ("user_id",)) -> DataFrame:
    """Last event per reader and item; later events overwrite earlier ones. Pre-aggregated before the shuffle."""
    rest = [c for c in events.columns if c not in (*per, "item_id", "event_ord")]
    return (events.groupBy(*per, "item_id").agg(F.max(F.struct("event_ord", *rest)).alias("_last"))
            .select(*per, "item_id", "_last.*"))


def step_of(reaction: Column) -> Column:
    """A like counts +1, anything else -2."""
    return F.when(reaction == "like", F.lit(1.0)).otherwise(F.lit(-2.0))


def weights(events: DataFrame, key: str, per: Sequence[str] = ("user_id",)) -> DataFrame:
    """Preference weight per value of `key` (channel or domain). Every event counts, repeats and reversals too."""
    return (events.where(F.coalesce(F.col(key), F.lit("")) != "")
            .groupBy(*per, key).agg(F.sum(step_of(F.col("reaction"))).alias("weight")))


def weights_by(events: DataFrame, keys: Sequence[str] = ("channel", "domain"), per: Sequence[str] = ("user_id",)) -> DataFrame:
    """(per, key, value, weight): the weights of several keys from one scan and one exchange.

    `key` comes out of the aggregation, so a filter on it stays above the exchange, and readers of single keys share that.
    """
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in keys]))
    return (events.select(*per, step_of(F.col("reaction")).alias("_step"), each.alias("_k"))
            .select(*per, "_step", F.col("_k.value").alias("value"), F.col("_k.key").alias("_key"))
            .where(F.coalesce(F.col("value"), F.lit("")) != "")
            .groupBy(*per, "_key", "value").agg(F.sum("_step").alias("weight"), F.max("_key").alias("key"))
            .select(*per, "key", "value", "weight"))


def learned_weights(events: DataFrame, per: Sequence[str] = ("user_id",)) -> dict[str, DataFrame]:
    """Both tables that `score_items` and `curate` take."""
    both = weights_by(events, ("channel", "domain"), per)
    return {name: both.where(F.col("key") == key).select(*per, F.col("value").alias(key), "weight")
            for name, key in (("source_weights", "channel"), ("domain_weights", "domain"))}


def stats_of_latest(latest: DataFrame, per: Sequence[str] = ("user_id",)) -> DataFrame:
    return latest.groupBy(*per).agg(F.count("*").alias("total"),
                                    F.count_if(F.col("reaction") == "like").alias("likes"),
                                    F.count_if(F.col("reaction") == "dislike").alias("dislikes"))


def reaction_stats(events: DataFrame, per: Sequence[str] = ("user_id",)) -> DataFrame:
    """Items reacted to, by latest reaction."""
    return stats_of_latest(latest_reactions(events.select(*per, "item_id", "event_ord", "reaction"), per), per)


def from_request_log(log: DataFrame) -> DataFrame:
    """Reactions in requested addresses. Requests of other paths, without id or with an unknown reaction drop out.

    The address is cut at `?`, `#`, `;` and `&`: `parse_url` would give up on all of it for one bad escape. Names and values
    are decoded, and a `%` that begins no escape stands for itself. Of a repeated parameter the first value that is not
    blank counts. Such events know neither channel nor domain. Further columns of the log stay.
    """
    url = F.col("url")

    def decoded(text: Column) -> Column:
        repaired = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(text.rlike("[%+]"), F.coalesce(F.try_url_decode(repaired), text)).otherwise(text)

    def by_decoded_names(query: Column) -> Column:
        given = F.filter(F.split(query, "&"), lambda p: p.rlike("(?s)^[^=]*=."))
        pairs = F.transform(given, lambda p: X.once(F.substring_index(p, "=", 1), lambda name: F.struct(
            decoded(name).alias("name"), F.substr(p, F.length(name) + 2).alias("value"))))
        return X.once(pairs, lambda held: F.struct(*[
            F.coalesce(F.get(F.filter(held, lambda p: p["name"] == n), F.lit(0))["value"], F.lit("")).alias(n) for n in ("id", "r", "t")]))

    # Names are hardly ever written with escapes, so patterns find the three values; the rest is taken apart.
    def parsed(query: Column) -> Column:
        escaped = query.rlike("(?:^|&)[^=&]*[%+][^=&]*=")
        as_written = F.struct(*[F.regexp_extract(query, f"(?:^|&){n}=([^&]+)", 1).alias(n) for n in ("id", "r", "t")])
        return X.once(F.when(escaped, by_decoded_names(query)).otherwise(as_written), lambda v: F.struct(
            decoded(v["id"]).alias("item_id"), decoded(v["r"]).alias("reaction"), decoded(v["t"]).alias("title")))

    # Exploded, so that the test of a value is not moved below its parsing and all of it done twice.
    event = F.explode(F.filter(F.array(parsed(F.regexp_extract(url, r"^[^?#]*[?]([^#]*)", 1))), lambda v: (v["item_id"] != "") & v["reaction"].isin("like", "dislike")))
    new = ("item_id", "reaction", "title", "channel", "domain")
    others = [c for c in log.columns if c not in ("event_ord", "ts", "user_id", "url", *new)]
    return (log.where(F.regexp_extract(url, r"^([^?#;]*)", 1) == "/feedback")
            .select("event_ord", "ts", "user_id", *others, event.alias("_v"))
            .select("event_ord", "ts", "user_id", "_v.*", F.lit("").alias("channel"), F.lit("").alias("domain"), *others))


def restore_items(events: DataFrame, numbered: DataFrame, per: Sequence[str] = ("brief_id",)) -> DataFrame:
    """Option: fill channel and domain of events whose id is an item's number in a known briefing."""
    items = numbered.select(*per, F.col("number").cast("string").alias("item_id"),
                            F.col("channel").alias("_channel"), F.col("domain").alias("_domain"))
    return (events.join(items, [*per, "item_id"], "left")
            .withColumn("channel", F.coalesce("_channel", "channel"))
            .withColumn("domain", F.coalesce("_domain", "domain"))
            .drop("_channel", "_domain"))


def parse_briefings(docs: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",), text: str = "md") -> DataFrame:
    """Items listed in briefing documents: number (position), title, channel, domain.

    One row per document comes in, so all of it happens inside the row, without a shuffle.
    """
    lines = F.split(F.col(text), "\n")
    numbered = F.transform(lines, lambda line, i: F.struct(
        line.alias("line"), F.coalesce(F.try_element_at(lines, (i + 2).cast("int")), F.lit("")).alias("next")))

    def heading_domain(line: Column) -> Column:
        named = F.filter(F.array(*[F.lit(d) for d in s.domains]), lambda d: F.contains(line, d))
        return F.when(line.startswith("## ") & F.contains(line, F.lit("领域")), F.get(named, F.lit(0)))

    def item(e: Column, domain: Column) -> Column:
        heading = X.strip_blanks(F.regexp_replace(e["line"], "^[# ]+", ""))
        at = F.instr(heading, ". ")
        title = F.when(at > 0, F.substr(heading, at + 2)).otherwise(heading)
        parts = F.split(e["next"], "·")
        return F.struct(title.alias("title"),
                        F.coalesce(X.strip_blanks(F.get(parts, F.lit(1))), F.lit("")).alias("channel"),
                        domain.alias("domain"))

    start = F.struct(F.lit("").alias("domain"),
                     F.expr("cast(array() as array<struct<title:string,channel:string,domain:string>>)").alias("items"))
    folded = F.aggregate(numbered, start, lambda acc, e: F.struct(
        F.coalesce(heading_domain(e["line"]), acc["domain"]).alias("domain"),
        F.when(e["line"].startswith("### "), F.array_append(acc["items"], item(e, acc["domain"])))
        .otherwise(acc["items"]).alias("items")))
    return (docs.select(*keys, F.posexplode(folded["items"]).alias("_at", "_item"))
            .select(*keys, (F.col("_at") + 1).cast("bigint").alias("number"), "_item.*"))


def reactions_by_number(reactions: DataFrame, parsed: DataFrame, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """Reactions given as (briefing, item number): events whose id is the item's title. Bad ones drop out."""
    return (reactions.where(F.col("reaction").isin("like", "dislike"))
            .join(parsed, [*keys, "number"])
            .withColumn("item_id", F.col("title")))


def keyword_weights(events: DataFrame, s: Settings, per: Sequence[str] = ("user_id",)) -> DataFrame:
    """(per, keyword, weight): what readers' reactions say about the configured keywords in the titles.

    A like adds one and anything else takes two off, as for channels; a keyword listed under two domains counts once.
    Only keywords that occur are produced, inside the row, and summed up before the shuffle.
    """
    written: dict[str, list[str]] = {}
    for k in sorted(set(s.all_keywords)):
        written.setdefault(k.lower(), []).append(k)
    found = X.matched_keywords(F.lower(F.coalesce("title", F.lit(""))), list(written))
    several = {low: ks for low, ks in written.items() if ks != [low]}
    # Keywords as they are written; most are written in one way, and many as they are compared.
    names = F.from_json(F.lit(json.dumps(several)), "map<string,array<string>>")
    hits = F.flatten(F.transform(found, lambda low: F.coalesce(F.try_element_at(names, low), F.array(low)))) if several else found
    points = F.when(F.col("reaction") == "like", 1).otherwise(-2)
    return (events.select(*per, points.alias("_points"), F.explode(hits).alias("keyword"))
            .groupBy(*per, "keyword").agg(F.sum("_points").cast("double").alias("weight")))


def preference_examples(events: DataFrame, most: int = 5, per: Sequence[str] = ("user_id",)) -> DataFrame:
    """(per, reaction, place, item_id, title): a reader's newest liked and disliked items, as examples for a prompt.

    The latest reaction to an item decides; the limit per reader also applies before the last shuffle.
    """
    latest = (events.groupBy(*per, "item_id")
              .agg(F.max_by(F.struct("reaction", "title", "event_ord"), "event_ord").alias("_e"))
              .select(*per, "item_id", "_e.*"))
    newest = Window.partitionBy(*per, "reaction").orderBy(F.col("event_ord").desc())
    return (latest.withColumn("place", F.row_number().over(newest).cast("bigint")).where(F.col("place") <= most)
            .select(*per, "reaction", "place", "item_id", "title"))
