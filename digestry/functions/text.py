"""Text expressions. All are built-in column functions."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# `trim` removes only U+0020; these are all characters Unicode counts as white space.
_BLANKS = r"\s\p{Z}\x1c-\x1f\x85"
# Words as runs of letters, numbers and underscores in any script. Java's \w would be ASCII only.
_WORD = r"[\p{L}\p{N}_]+"
_DURATION = r"^PT(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?"

# Keyword tests up to this many are written out, so that code generation covers them.
_UNROLLED_KEYWORDS = 200
# Characters of the runs by which longer lists are looked up.
_RUN = 3


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def strip_blanks(value: Column) -> Column:
    return F.regexp_replace(value, f"^[{_BLANKS}]+|[{_BLANKS}]+$", "")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", "")


def searchable(title: Column, description: Column) -> Column:
    """Lower-cased text the keyword rules look at."""
    return F.lower(F.concat(text_or_empty(title), F.lit(" "), text_or_empty(description)))


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many keywords occur as a substring of the lower-cased text. No join, hence no shuffle."""
    words = [k.lower() for k in keywords]
    if not words:
        return F.lit(0)
    if len(words) <= _UNROLLED_KEYWORDS:
        total = F.contains(text, F.lit(words[0])).cast("int")
        for word in words[1:]:
            total = total + F.contains(text, F.lit(word)).cast("int")
        return F.coalesce(total, F.lit(0))
    found = once(text, lambda t: F.aggregate(_looked_up(t, words), F.lit(0), lambda n, e: n + e["n"]))
    return F.coalesce(found, F.lit(0))


def matched_keywords(text: Column, keywords: Sequence[str]) -> Column:
    """Distinct keywords, lower-cased, that occur in the lower-cased text, in no order; null for a null text."""
    words = sorted({k.lower() for k in keywords})
    if len(words) <= _UNROLLED_KEYWORDS:
        table = F.array(*[F.lit(w) for w in words]).cast("array<string>")
        return once(text, lambda t: F.when(t.isNotNull(), F.filter(table, lambda w: F.contains(t, w))))
    return once(text, lambda t: F.when(t.isNotNull(), F.transform(_looked_up(t, words), lambda e: e["w"])))


def _looked_up(text: Column, words: Sequence[str]) -> Column:
    """Entries (w, n: how often it is listed) of the words that occur in the text.

    Every word waits under its rarest run of up to three characters; a text looks up its own runs, each once, and tests
    only the words that wait there. The work follows the text's length and its matches, not the number of words. `text`
    is to be a variable of a lambda.
    """
    times = Counter(words)
    runs = {w: [w[i:i + _RUN] for i in range(max(1, len(w) - _RUN + 1))] for w in times}
    common = Counter(r for found in runs.values() for r in set(found))
    buckets: list[list[dict]] = [[] for _ in range(2 * len(times))]
    for word, n in sorted(times.items()):
        key = min(runs[word], key=lambda r: (common[r], r))
        buckets[zlib.crc32(key.encode()) % len(buckets)].append({"k": key, "w": word, "n": n})
    # A constant of the plan; as text it is one expression whatever its size.
    table = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<k:string,w:string,n:int>>>")

    def runs_of(chars: Column, length: int) -> Column:
        starts = F.when(F.size(chars) >= length, F.sequence(F.lit(0), F.size(chars) - length)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(*[F.get(chars, i + j) for j in range(length)]))

    lengths = sorted({len(w) if len(w) < _RUN else _RUN for w in times} - {0})
    empty = F.array(*[F.lit("")] * ("" in times)).cast("array<string>")
    keys = once(F.split(text, ""), lambda chars: F.array_distinct(F.concat(empty, *[runs_of(chars, n) for n in lengths])))
    return F.flatten(F.transform(keys, lambda k: F.filter(F.get(table, F.pmod(F.crc32(k), F.lit(len(buckets))).cast("int")),
                                                          lambda e: (e["k"] == k) & F.contains(text, e["w"]))))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a costly value one time for an expression that refers to it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a non-empty word."""
    gone = F.length(text) - F.length(F.replace(text, word, F.lit("")))
    return (gone / F.length(word)).cast("bigint")


def title_tokens(title: Column) -> Column:
    """Set of words of a title, in order of first appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_or_empty(title)), F.lit(_WORD), 0))


def _duration_part(duration: Column, group: int) -> Column:
    return F.coalesce(F.regexp_extract(duration, _DURATION, group).try_cast("bigint"), F.lit(0))


def duration_seconds(duration: Column) -> Column:
    """Seconds of an ISO-8601 time duration; anything else counts as 0."""
    text = text_or_empty(duration)
    return _duration_part(text, 1) * 3600 + _duration_part(text, 2) * 60 + _duration_part(text, 3)


def duration_label(duration: Column) -> Column:
    """Hours and minutes for the reader; empty when the duration cannot be read."""
    text = text_or_empty(duration)
    hours, minutes = _duration_part(text, 1), _duration_part(text, 2)
    return (F.when(~text.startswith("PT"), "")
            .when(hours > 0, F.concat(hours.cast("string"), F.lit("小时"), minutes.cast("string"), F.lit("分钟")))
            .otherwise(F.concat(minutes.cast("string"), F.lit(" 分钟"))))


def simplify_script(value: Column, lang: Column, only_lang: str | None, table: tuple[str, str]) -> Column:
    """Replace characters one by one by a given table, for rows of one language or (None) for all rows."""
    changed = F.translate(value, table[0], table[1])
    return changed if only_lang is None else F.when(lang == only_lang, changed).otherwise(value)


def path_encode(value: Column) -> Column:
    """Percent-encode for a URL, with the blank as %20 and `/`, `~` kept. `url_encode` does it as a form."""
    encoded = F.url_encode(value)
    for form, path in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(form), F.lit(path))
    return encoded


def one_decimal_percent(part: Column, whole: Column) -> Column:
    """100 * part / whole as text with one decimal, the binary value rounded half to even; '0' for nothing."""
    x = part.cast("double") / whole * 100
    scale = F.when(x >= 1, F.lit(float(2 ** 52))).otherwise(F.lit(float(2 ** 58)))
    unit = scale.cast("bigint")
    # x * scale is a whole number, so floor and remainder of ten times it are exact.
    tenfold = (x * scale).cast("bigint") * 10
    rest = F.pmod(tenfold, unit)
    floor = ((tenfold - rest) / unit).cast("bigint")
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (F.pmod(floor, F.lit(2)) == 1))
    tenths = floor + up.cast("bigint")
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))
    return F.when(F.coalesce(whole, F.lit(0)) > 0, text).otherwise("0")


def parse_response(raw: Column) -> tuple[Column, Column]:
    """Summary and insight of one generated answer."""
    parts = F.split(raw, "Why it matters")
    bare = strip_blanks(F.replace(F.replace(parts[0], F.lit("摘要："), F.lit("")), F.lit("摘要:"), F.lit("")))
    insight = strip_blanks(F.regexp_replace(F.get(parts, F.lit(1)), "^[：:]+", ""))
    marked = F.contains(raw, F.lit("Why it matters"))
    labelled = F.contains(raw, F.lit("摘要：")) | F.contains(raw, F.lit("摘要:"))
    return F.when(marked | labelled, bare).otherwise(raw), F.when(marked, insight).otherwise("")
