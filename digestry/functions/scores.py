"""The additive quality rules, one column expression each."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from digestry.functions import text as X
from digestry.rules import LINK_MARKS

_HOUR = 3_600_000_000  # microseconds


def _zero(count: Column) -> Column:
    return F.coalesce(count, F.lit(0))


def credibility(channel: Column, views: Column, whitelist: Sequence[str]) -> Column:
    known = X.text_or_empty(channel).isin(list(whitelist)) if whitelist else F.lit(False)
    return F.when(known, 25).when(_zero(views) > 10000, 15).otherwise(5)


def length(kind: Column, duration: Column, description: Column) -> Column:
    seconds = X.duration_seconds(duration)
    chars = F.length(X.text_or_empty(description))
    video = F.when(seconds >= 600, 15).when(seconds >= 300, 10).when(seconds >= 120, 5).otherwise(0)
    article = F.when(chars >= 1000, 15).when(chars >= 500, 10).when(chars >= 200, 5).otherwise(0)
    return F.when(kind == "YouTube", video).otherwise(article)


def engagement(kind: Column, authority: Column, likes: Column, comments: Column) -> Column:
    level = F.coalesce(authority, F.lit("medium"))
    by_authority = F.when(level == "high", 15).when(level == "medium", 10).otherwise(3)
    reactions = _zero(likes) + 2 * _zero(comments)
    by_reactions = F.when(reactions > 5000, 20).when(reactions > 1000, 15).when(reactions > 100, 10).otherwise(3)
    return F.when(kind == "RSS", by_authority).otherwise(by_reactions)


def relevance(text: Column, keywords: Sequence[str]) -> Column:
    return F.least(5 * X.keyword_hits(text, keywords), F.lit(20))


def recency(published_at: Column, as_of: datetime) -> Column:
    age = F.unix_micros(F.lit(as_of)) - F.unix_micros(published_at)
    return (F.when(published_at.isNull(), 3)
            .when(age < 6 * _HOUR, 10).when(age < 12 * _HOUR, 7).when(age < 24 * _HOUR, 5).otherwise(0))


def tracked_link(text: Column) -> Column:
    first, *others = [F.contains(text, F.lit(mark)) for mark in LINK_MARKS]
    for found in others:
        first = first | found
    return first


def spam_penalty(text: Column, spam_keywords: Sequence[str]) -> Column:
    """Points to take off: by keywords, and on their own by tracking links."""
    by_words = F.least(15 * X.keyword_hits(text, spam_keywords), F.lit(45))
    return by_words + F.when(tracked_link(text), 15).otherwise(0)


def preference(source_weight: Column, domain_weight: Column) -> Column:
    """Learned adjustment; the cast drops the fraction toward zero."""
    return (3 * F.coalesce(source_weight, F.lit(0.0)) + 2 * F.coalesce(domain_weight, F.lit(0.0))).cast("bigint")
