"""Near-duplicate titles.

Two titles are similar when they share more than half of the words of the smaller one. Walking a briefing in rank
order, a title is dropped if it is similar to one *kept* before it. `match_titles` gives every row the ordinal of
the first kept title it is similar to, or NULL if it is kept.

Briefings of up to `fold_rows` rows are walked inside one array expression. Larger ones, of any size, go through
`_match_large`, which never puts a whole briefing into one task and never lists all pairs of a group:

* Rows with the same set of words collapse to the first of them (they share its fate), pre-aggregated.
* The best `fold_rows` titles are walked in an array; everything similar to a kept one is dropped at once. Then
  the next, four times larger, stretch of ranks follows. A group of near-copies thus disappears with its first
  member.
* Within a stretch, similar pairs are found by a token join with a prefix filter and resolved in rounds. Briefings
  with too many candidate pairs in it, counted beforehand from token frequencies, take a short stretch instead.
* Tables of words are joined by shuffle: Spark takes a list of words for as small as its file and would send it, many
  times larger once each word has a row, through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text as X
from digestry.operators.ranking import ranked
from digestry.session import settle
from digestry.settings import Settings

MOST_PARTS = 8  # tables of the rounds done that a plan lists; more are merged


def similar(a: Column, b: Column) -> Column:
    """Whole-number form of overlap / smaller > 1/2; false for an empty set."""
    return 2 * F.size(F.array_intersect(a, b)) > F.least(F.size(a), F.size(b))


def marked(words: Column) -> Column:
    """A set of words with a 64-bit mark, one bit per word, and the number of words lost to shared bits."""
    def bit(word: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.xxhash64(word), F.lit(64)).cast("int"))

    bits = F.aggregate(words, F.lit(0).cast("bigint"), lambda acc, w: acc.bitwiseOR(bit(w)))
    both = F.struct(words.alias("words"), bits.alias("bits"))
    return F.get(F.transform(F.array(both), lambda b: F.struct(
        b["words"].alias("words"), b["bits"].alias("bits"),
        (F.size(b["words"]) - F.bit_count(b["bits"])).alias("lost"))), F.lit(0))


def similar_marked(a: Column, b: Column) -> Column:
    """`similar` for marked sets. Sets cannot share more words than they share bits, plus words lost to shared
    bits in the set that lost fewer; this rules most pairs out before any words are compared."""
    at_most = F.bit_count(a["bits"].bitwiseAND(b["bits"])) + F.least(a["lost"], b["lost"])
    return ((2 * at_most > F.least(F.size(a["words"]), F.size(b["words"])))
            & similar(a["words"], b["words"]))


def _shuffled(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which no side passes the driver."""
    return left.join(right.hint("merge"), list(on), how)


def _walk(entries: Column) -> Column:
    """Fold ordered entries (`_tie`, `_set`) into [(`_tie`, `_of`)]: `_of` is the first kept similar one."""
    def kept_entry(e: Column) -> Column:
        return F.struct(e["_tie"].alias("_tie"), e["_set"].alias("_set"))

    none = F.slice(entries, 1, 0)
    start = F.struct(F.transform(none, kept_entry).alias("kept"), F.transform(none, lambda e: F.struct(
        e["_tie"].alias("_tie"), F.when(F.lit(False), e["_tie"]).alias("_of"))).alias("done"))

    def step(acc: Column, e: Column) -> Column:
        first = F.get(F.filter(acc["kept"], lambda k: similar_marked(k["_set"], e["_set"])), F.lit(0))["_tie"]
        return X.once(first, lambda of: F.struct(
            F.when(of.isNull(), F.array_append(acc["kept"], kept_entry(e))).otherwise(acc["kept"]).alias("kept"),
            F.array_append(acc["done"], F.struct(e["_tie"].alias("_tie"), of.alias("_of"))).alias("done")))

    return F.aggregate(entries, start, step)["done"]


def _fold(rows: DataFrame, keys: Sequence[str], score: str, ordinal: str, carry: Sequence[str] = ()) -> DataFrame:
    """(keys, ordinal, duplicate_of, carried columns) for briefings known to be small enough for one array."""
    entry = F.struct((-F.col(score)).alias("_worst"), F.col(ordinal).alias("_tie"), F.col("_words"), *carry)
    lists = (rows.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_entries"))
             .withColumn("_done", _walk(F.transform("_entries", lambda e: F.struct(
                 e["_tie"].alias("_tie"), marked(e["_words"]).alias("_set"))))))
    # Both arrays are in walking order.
    return (lists.select(*keys, F.explode(F.arrays_zip("_entries", "_done")).alias("_z"))
            .select(*keys, F.col("_z._done._tie").alias(ordinal), F.col("_z._done._of").alias("duplicate_of"),
                    *[F.col("_z._entries")[c].alias(c) for c in carry]))


def _split_by_size(stored: DataFrame, s: Settings, keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Rows of briefings that fit one array, and of the larger ones (None if there are none)."""
    large = (stored.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > s.fold_rows).select(*keys))
    if large.isEmpty():
        return stored, None
    large = settle(large, "large-briefs")
    return stored.join(large, keys, "left_anti"), stored.join(large, keys, "left_semi")


def match_titles(rows: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",), score: str = "quality_score",
                 ordinal: str = "ord", title: str = "title") -> DataFrame:
    """(keys, ordinal, duplicate_of) for all rows. `ordinal` must be unique within a briefing."""
    keys = list(keys)
    return _match(settle(rows.select(*keys, score, ordinal, title), "titles"), s, keys, score, ordinal, title)


def _match(stored: DataFrame, s: Settings, keys: list[str], score: str, ordinal: str, title: str) -> DataFrame:
    slim = stored.select(*keys, score, ordinal, F.array_sort(X.title_tokens(F.col(title))).alias("_words"))
    small, large = _split_by_size(slim, s, keys)
    done = _fold(small, keys, score, ordinal)
    return done if large is None else done.unionByName(_match_large(large, s, keys, score, ordinal))


def drop_similar_titles(rows: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",),
                        score: str = "quality_score", ordinal: str = "ord", title: str = "title",
                        stored: bool = False) -> DataFrame:
    """Rows whose title is kept. Hand in the columns needed later only: rows are stored first (or say `stored`)."""
    keys = list(keys)
    rows = rows if stored else settle(rows, "titled-rows")
    columns = [c for c in rows.columns if c not in (*keys, ordinal)]
    small, large = _split_by_size(rows.withColumn("_words", F.array_sort(X.title_tokens(F.col(title)))), s, keys)
    kept = (_fold(small, keys, score, ordinal, columns).where(F.col("duplicate_of").isNull())
            .select(*rows.columns))
    if large is None:
        return kept
    unique = (_match_large(large.select(*keys, score, ordinal, "_words"), s, keys, score, ordinal)
              .where(F.col("duplicate_of").isNull()).select(*keys, ordinal))
    return kept.unionByName(_shuffled(large.select(*rows.columns), unique, [*keys, ordinal], "left_semi"))


def title_matches(rows: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",), score: str = "quality_score",
                  ordinal: str = "ord", title: str = "title") -> DataFrame:
    """Each dropped title with the kept title that displaces it: one row per dropped title, never all pairs."""
    keys = list(keys)
    rows = settle(rows.select(*keys, score, ordinal, title), "titles")
    found = _match(rows, s, keys, score, ordinal, title).where(F.col("duplicate_of").isNotNull())
    words = F.array_sort(X.title_tokens(F.col(title)))
    dropped = rows.select(*keys, ordinal, words.alias("_a"))
    kept = rows.select(*keys, F.col(ordinal).alias("duplicate_of"), words.alias("_b"))
    return (_shuffled(_shuffled(found, dropped, [*keys, ordinal]), kept, [*keys, "duplicate_of"])
            .select(*keys, ordinal, "duplicate_of",
                    F.size(F.array_intersect("_a", "_b")).cast("bigint").alias("shared_words"),
                    F.least(F.size("_a"), F.size("_b")).cast("bigint").alias("smaller_words")))


# ---------------------------------------------------------------------------------------------------------------
# Briefings of any size.

def _match_large(slim: DataFrame, s: Settings, keys: list[str], score: str, ordinal: str) -> DataFrame:
    slim = settle(slim, "titles")
    # An empty title resembles nothing; a repeated set of words shares the fate of its first row.
    empty = (slim.where(F.size("_words") == 0)
             .select(*keys, ordinal, F.lit(None).cast(slim.schema[ordinal].dataType).alias("duplicate_of")))
    signature = F.array_join("_words", " ").alias("_sig")
    filled = slim.where(F.size("_words") > 0).select(*keys, signature, score, ordinal, "_words")
    sets = settle(
        filled.groupBy(*keys, "_sig")
        .agg(F.min(F.struct((-F.col(score)).alias("_worst"), F.col(ordinal).alias("_tie"))).alias("_first"))
        .select(*keys, "_sig", (-F.col("_first._worst")).alias("_score"), F.col("_first._tie").alias("_tie"),
                F.split("_sig", " ").alias("_words")), "title-sets")
    nodes = settle(_rare_first(ranked(sets.drop("_sig"), s, keys, "_score", "_tie", "_rank"), keys), "title-nodes")

    found = []  # tables (keys, _rank, _of)
    head = nodes.where(F.col("_rank") <= s.fold_rows)
    done = settle(_fold(head.withColumn("_z", F.lit(0)), keys, "_z", "_rank")
                  .select(*keys, "_rank", F.col("duplicate_of").alias("_of")), "title-head")
    found.append(done.where(F.col("_of").isNotNull()))
    kept = _shuffled(done.where(F.col("_of").isNull()), head, [*keys, "_rank"]).select(*head.columns)
    rest, size = nodes.where(F.col("_rank") > s.fold_rows), s.fold_rows * 4
    while True:
        hit = settle(_first_match(rest, kept, keys), "title-hits")
        found.append(hit)
        rest = settle(_shuffled(rest, hit, [*keys, "_rank"], "left_anti"), "title-rest")
        left = rest.agg(F.min("_rank")).first()[0]
        if left is None:
            break
        low = left - 1
        end = F.lit(low + size)
        crowded = settle(_crowded(rest.where(F.col("_rank") <= end), s, keys), "title-crowded")
        if not crowded.isEmpty():
            rest = rest.join(crowded.withColumn("_crowded", F.lit(True)), keys, "left")
            end = F.when(F.col("_crowded"), low + s.fold_rows).otherwise(low + size)
        stretch = rest.where(F.col("_rank") <= end).select(*nodes.columns)
        inside = settle(_resolve(_pairs(stretch, keys), s, keys), "title-stretch")
        found.append(inside)
        kept = settle(_shuffled(stretch, inside, [*keys, "_rank"], "left_anti"), "title-kept")
        rest, size = rest.where(F.col("_rank") > end).select(*nodes.columns), size * 4
        if len(found) > MOST_PARTS:
            found = [settle(_together(found), "title-found")]

    of = _together(found)
    # Back from ranks to ordinals, and from sets of words to rows.
    names = nodes.select(*keys, F.col("_rank").alias("_of"), F.col("_tie").alias("_of_tie"))
    by_set = _shuffled(_shuffled(nodes.select(*keys, "_rank", "_tie"), of, [*keys, "_rank"], "left"),
                       names, [*keys, "_of"], "left").select(*keys, "_tie", "_of_tie")
    by_sig = _shuffled(sets.select(*keys, "_sig", "_tie"), by_set, [*keys, "_tie"])
    rows = (_shuffled(filled.select(*keys, "_sig", ordinal), by_sig, [*keys, "_sig"])
            .select(*keys, ordinal, F.coalesce("_of_tie", F.when(F.col("_tie") != F.col(ordinal), F.col("_tie")))
                    .alias("duplicate_of")))
    return empty.unionByName(rows)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rare_first(sets: DataFrame, keys: list[str]) -> DataFrame:
    """Order the words of each set by their frequency in the briefing, rarest first."""
    words = sets.select(*keys, "_rank", F.explode("_words").alias("_word"))
    frequency = words.groupBy(*keys, "_word").agg(F.count("*").alias("_df"))
    ordered = (_shuffled(words, frequency, [*keys, "_word"]).groupBy(*keys, "_rank")
               .agg(F.array_sort(F.collect_list(F.struct("_df", "_word"))).alias("_w")))
    return (_shuffled(sets.drop("_words"), ordered, [*keys, "_rank"])
            .withColumn("_words", F.col("_w._word")).drop("_w"))


def _prefix(nodes: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The n - n div 2 rarest words: a set sharing more than half of n words with this one has one of them."""
    n = F.size("_words")
    rare = F.slice("_words", F.lit(1), (n - F.floor(n / 2)).cast("int"))
    return nodes.select(*keys, *more, F.explode(rare).alias("_word"))


def _postings(nodes: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return nodes.select(*keys, *more, F.explode("_words").alias("_word"))


def _named(nodes: DataFrame, keys: list[str], side: str) -> DataFrame:
    return nodes.select(*keys, F.col("_rank").alias(f"_{side}"), "_words", F.col("_words").alias(f"_{side}w"))


def _touching(left: DataFrame, right: DataFrame, keys: list[str], extra: Column) -> DataFrame:
    """Similar (left, right) nodes under a condition, possibly repeated. The smaller set offers its rarest words."""
    on = [*keys, "_word"]
    a, b = _named(left, keys, "l"), _named(right, keys, "r")
    true_pair = similar(F.col("_lw"), F.col("_rw")) & extra
    smaller_left = (_shuffled(_prefix(a, keys, "_l", "_lw"), _postings(b, keys, "_r", "_rw"), on)
                    .where((F.size("_lw") <= F.size("_rw")) & true_pair))
    smaller_right = (_shuffled(_postings(a, keys, "_l", "_lw"), _prefix(b, keys, "_r", "_rw"), on)
                     .where((F.size("_lw") > F.size("_rw")) & true_pair))
    return smaller_left.select(*keys, "_l", "_r").unionByName(smaller_right.select(*keys, "_l", "_r"))


def _first_match(rest: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _rank, _of): nodes of `rest` similar to a kept node, with the first such node."""
    return (_touching(rest, kept, keys, F.lit(True)).groupBy(*keys, F.col("_l").alias("_rank"))
            .agg(F.min("_r").alias("_of")))


def _pairs(stretch: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct similar pairs (keys, _later, _earlier) within a stretch of ranks."""
    return (_touching(stretch, stretch, keys, F.col("_l") != F.col("_r"))
            .select(*keys, F.greatest("_l", "_r").alias("_later"), F.least("_l", "_r").alias("_earlier"))
            .distinct())


def _crowded(stretch: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    """Briefings for which the token join would look at too many pairs, from token counts alone."""
    on = [*keys, "_word"]
    left = _prefix(stretch, keys).groupBy(*on).agg(F.count("*").cast("double").alias("_p"))
    right = _postings(stretch, keys).groupBy(*on).agg(F.count("*").cast("double").alias("_q"))
    pairs = _shuffled(left, right, on).groupBy(*keys).agg(F.sum(2 * F.col("_p") * F.col("_q")).alias("_pairs"))
    sizes = stretch.groupBy(*keys).agg(F.count("*").alias("_n"))
    return (pairs.join(sizes, keys)
            .where(F.col("_pairs") > F.greatest(F.lit(s.pair_budget), F.col("_n") * s.pairs_per_title)).select(*keys))


def _resolve(pairs: DataFrame, s: Settings, keys: list[str]) -> DataFrame:
    """(keys, _rank, _of): which nodes of a graph of similar pairs the walk drops, and by which kept node.

    In a round, nodes without an undecided earlier neighbour are kept and their later neighbours dropped. As soon
    as a briefing has few pairs left, one task finishes it; a long chain therefore does not need many rounds.
    """
    all_pairs = settle(pairs, "pairs")
    left, dropped = all_pairs, []
    while True:
        sizes = left.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > s.pairs_per_task)
        heavy = sizes.select(*keys)
        if heavy.isEmpty():
            break
        heavy = settle(heavy, "pairs-heavy")
        dropped.append(settle(_finish(left.join(heavy, keys, "left_anti"), keys), "dropped"))
        left = left.join(heavy, keys, "left_semi")
        roots = _shuffled(left.select(*keys, F.col("_earlier").alias("_rank")).distinct(),
                          left.select(*keys, F.col("_later").alias("_rank")), [*keys, "_rank"], "left_anti")
        gone = settle(_shuffled(left, roots.withColumnRenamed("_rank", "_earlier"), [*keys, "_earlier"], "left_semi")
                      .select(*keys, F.col("_later").alias("_rank")).distinct(), "dropped")
        dropped.append(gone)
        left = _shuffled(left, gone.withColumnRenamed("_rank", "_earlier"), [*keys, "_earlier"], "left_anti")
        left = settle(_shuffled(left, gone.withColumnRenamed("_rank", "_later"), [*keys, "_later"], "left_anti"), "pairs")
        if len(dropped) > MOST_PARTS:
            dropped = [settle(_together(dropped), "dropped")]
    lost = settle(_together([_finish(left, keys), *dropped]), "dropped")
    return (_shuffled(all_pairs, lost.withColumnRenamed("_rank", "_earlier"), [*keys, "_earlier"], "left_anti")
            .groupBy(*keys, F.col("_later").alias("_rank")).agg(F.min("_earlier").alias("_of")))


def _finish(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Dropped nodes of briefings with at most `pairs_per_task` pairs."""
    schema = ", ".join([*(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys), "_rank BIGINT"])

    def greedy(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_later", "_earlier"])
        gone: set[int] = set()
        for later, earlier in zip(group["_later"], group["_earlier"]):
            if earlier not in gone:
                gone.add(later)
        out = pd.DataFrame({"_rank": sorted(gone)}, dtype="int64")
        for at, k in enumerate(keys):
            out.insert(at, k, group[k].iloc[0])
        return out

    return pairs.groupBy(*keys).applyInPandas(greedy, schema)
