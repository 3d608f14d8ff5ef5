"""Documents that hold benchmark items, also re-parameterised ones. DataFrame operations only.

Texts become templates: numbers, names and units turn into typed placeholders. Every window of template words is looked
up in a hash join, once with names as placeholders and once with names as plain words, as other capitals make other
names. The pairs found are then looked at window by window, and the values under the placeholders have to correspond one
to one. Items that are mostly placeholders are found word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.session import settle

WINDOW = 5
SOLID = 3             # words of a window that are no placeholder, at least
COVERED = 0.6         # part of an item's windows found in a document, or
RUN = 9               # windows in a row: 13 words
CONSISTENT = 0.8      # part of the slots that follow the item's values one to one
BROADCAST_WINDOWS = 1_000_000  # at 16 bytes each; longer benchmarks are joined by shuffle

MARK = "\u0001"
NAME = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+"
UNITS = ("%", "km", "m", "cm", "mm", "kg", "g", "mg", "l", "ml", "lb", "oz", "ft", "mi", "mph", "kmh", "s", "sec", "min", "h", "hours", "hour", "minutes",
         "minute", "seconds", "days", "day", "weeks", "months", "years", "year", "dollars", "euros", "cents", "usd", "eur", "kwh", "kw", "w", "v", "mb", "gb")


def template_words(text: Column, values: bool = False, names: bool = True) -> Column:
    """Lower-cased words with #num, #name and #unit for numbers, capitalised words inside a sentence, and units after
    a number. With `values`, a placeholder is followed by a mark and what it stands for. Without `names`, these are words
    like others; the words' places are the same."""
    kept = MARK + "$0" if values else ""
    plain = F.translate(F.coalesce(text, F.lit("")), "#" + MARK, "  ")
    named = F.lower(F.regexp_replace(plain, NAME, f"#name{kept}") if names else plain)
    counted = F.regexp_replace(named, r"\p{Nd}+", f" #num{kept} ")
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    number = rf"(#num{MARK}\p{{Nd}}+)" if values else "(#num)"
    measured = F.regexp_replace(counted, rf"{number} +({units})(?!\p{{L}})", "$1 #unit" + (MARK + "$2" if values else "") + " ")
    return F.filter(F.split(measured, rf"[^\p{{L}}\p{{N}}\p{{M}}#{MARK}%]+"), lambda w: w != "")


def _template(word: Column) -> Column:
    return F.regexp_replace(word, MARK + "(?s).*", "")


def _unnamed(word: Column) -> Column:
    """The template word if names are plain words."""
    return _template(F.regexp_replace(word, "^#name" + MARK, ""))


def _value(word: Column) -> Column:
    return F.regexp_replace(word, "(?s)^.*" + MARK, "")


def _windows(words: Column) -> Column:
    """(p, h) of the windows that begin at each word."""
    def of(held: Column) -> Column:
        last = F.size(held) - WINDOW
        starts = F.when(last >= 0, F.sequence(F.lit(0), last))
        return F.transform(starts, lambda i: F.struct(i.alias("p"), F.xxhash64(F.slice(held, i + 1, F.lit(WINDOW))).alias("h")))

    # As the variable of a lambda the words are made once per row, not once per window.
    return F.transform(F.array(words), of)[0]


def find_items(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(text_key, item_id, covered, run, consistent) of each item found in a text of docs (text_key, text).

    benchmark: (item_id, text). Items of fewer than five template words have no window and are found nowhere, as are
    null texts. Windows that are mostly placeholders say nothing by themselves: they count where they continue an
    alignment that other windows made. An item with no other windows is found if a text has all its words and values in
    a row; one without any word that is no placeholder is found nowhere.
    """
    items = benchmark.select("item_id", template_words(F.col("text"), values=True).alias("full")).where("item_id is not null")
    items = settle(items.withColumn("words", F.transform("full", _template)).withColumn("plain", F.transform("full", _unnamed)), "items")
    told = lambda w: F.size(F.filter(w, lambda x: ~x.startswith("#")))
    both = [items.select("item_id", F.explode(_windows(F.col(c))).alias("w"), F.col(c).alias("held")) for c in ("words", "plain")]
    windows = both[0].unionAll(both[1]).select("item_id", F.col("w.p").alias("q"), F.col("w.h").alias("h"), told(F.slice("held", F.col("w.p") + 1, F.lit(WINDOW))).alias("told"))
    windows = settle(windows.distinct(), "item-windows")
    solid = windows.where(F.col("told") >= SOLID).drop("told")
    n_windows = windows.groupBy("item_id").agg(F.countDistinct("q").alias("windows"))
    loose = windows.join(solid.select("item_id", "q").distinct(), ["item_id", "q"], "left_anti").drop("told")
    # Items without solid windows are looked for at the window that tells most.
    anchors = (windows.join(solid.select("item_id").distinct(), "item_id", "left_anti").where("told > 0")
               .groupBy("item_id").agg(F.max_by(F.struct("q", "h"), F.struct("told", "q", "h")).alias("w")).select("item_id", F.col("w.q").alias("q"), F.col("w.h").alias("h")))
    anchors = settle(anchors, "anchors")
    keys = solid.select("h").union(anchors.select("h")).distinct()
    if keys.count() <= BROADCAST_WINDOWS:
        keys = F.broadcast(keys)

    # Names as words make other windows only in texts that have names.
    text = F.col("text")
    as_words = F.when(text.rlike(NAME), _windows(template_words(text, names=False)))
    met = docs.select("text_key", F.explode(F.concat(F.coalesce(_windows(template_words(text)), F.array()), F.coalesce(as_words, F.array()))).alias("w"))
    met = met.select("text_key", F.col("w.h").alias("h"))
    texts = settle(met.join(keys, "h", "left_semi").select("text_key").distinct(), "suspects")
    full = (docs.join(texts, "text_key", "left_semi").dropDuplicates(["text_key"])
            .select("text_key", template_words(F.col("text"), values=True).alias("full")))
    full = settle(full, "suspect-words").withColumn("words", F.transform("full", _template)).withColumn("plain", F.transform("full", _unnamed))

    of_words, of_plain = (full.select("text_key", F.explode(_windows(F.col(c))).alias("w")) for c in ("words", "plain"))
    own = settle(of_words.unionAll(of_plain).select("text_key", F.col("w.p").alias("p"), F.col("w.h").alias("h")).distinct(), "suspect-windows")
    places = ["text_key", "item_id", "p", "q", (F.col("p") - F.col("q")).alias("shift")]
    hits = settle(own.join(solid, "h").select(*places).distinct(), "hits")

    # Only where they can decide: pairs that reach the limits if all their loose windows fit.
    most = hits.groupBy("text_key", "item_id", "shift").agg(F.count("*").alias("n"))
    most = most.groupBy("text_key", "item_id").agg(F.max("n").alias("n")).join(
        hits.groupBy("text_key", "item_id").agg(F.countDistinct("q").alias("found")), ["text_key", "item_id"])
    n_loose = loose.groupBy("item_id").agg(F.countDistinct("q").alias("loose"))
    near = most.join(n_loose, "item_id").join(n_windows, "item_id").where(
        ((F.col("found") + F.col("loose")) / F.col("windows") >= COVERED) | (F.col("n") + F.col("loose") >= RUN))
    lines = hits.join(near.select("text_key", "item_id"), ["text_key", "item_id"]).select("text_key", "item_id", "shift").distinct()
    more = (lines.join(loose, "item_id").withColumn("p", F.col("q") + F.col("shift")).join(own, ["text_key", "p", "h"])
            .select("text_key", "item_id", "p", "q", "shift").distinct())
    hits = settle(hits.unionAll(more), "all-hits")

    at = own.join(anchors, "h").select(*places).where("shift >= 0").select("text_key", "item_id", "shift").distinct()
    at = at.join(items.select("item_id", F.transform("full", _value).alias("sought")), "item_id").join(full.select("text_key", "full"), "text_key")
    exact = (at.where(F.transform(F.slice("full", F.col("shift") + 1, F.size("sought")), _value) == F.col("sought"))
             .groupBy("text_key", "item_id").agg(F.max(F.size("sought") - WINDOW + 1).cast("long").alias("run"))
             .select("text_key", "item_id", F.lit(1.0).alias("covered"), "run", F.lit(1.0).alias("consistent")))

    covered = (hits.groupBy("text_key", "item_id").agg(F.countDistinct("q").alias("found")).join(n_windows, "item_id")
               .select("text_key", "item_id", (F.col("found") / F.col("windows")).alias("covered")))
    along = hits.groupBy("text_key", "item_id", "shift").agg(F.count("*").alias("n"))
    best = along.groupBy("text_key", "item_id").agg(F.max("n").alias("run"), F.max_by("shift", F.struct("n", "shift")).alias("shift"))
    found = covered.join(best, ["text_key", "item_id"]).where((F.col("covered") >= COVERED) | (F.col("run") >= RUN))
    found = settle(found, "found")

    # Slots side by side, along the shift with most windows: how many follow the commonest value for their item value,
    # and the other way round.
    slots = lambda rows, key, at, name: (
        rows.select(key, F.posexplode("full").alias(at, "word")).where(F.col("word").startswith("#"))
        .select(key, at, F.regexp_replace("word", "(?s)^.*" + MARK, "").alias(name)))
    of_item = slots(items, "item_id", "q", "a")
    of_text = slots(full.join(found.select("text_key").distinct(), "text_key", "left_semi"), "text_key", "p", "b")
    pairs = (found.join(of_item, "item_id").withColumn("p", F.col("q") + F.col("shift")).join(of_text, ["text_key", "p"])
             .groupBy("text_key", "item_id", "a", "b").agg(F.count("*").alias("n")))
    total = pairs.groupBy("text_key", "item_id").agg(F.sum("n").alias("total"))
    for side in ("a", "b"):
        most = pairs.groupBy("text_key", "item_id", side).agg(F.max("n").alias("most"))
        total = total.join(most.groupBy("text_key", "item_id").agg(F.sum("most").alias(f"by_{side}")), ["text_key", "item_id"])
    agreed = total.select("text_key", "item_id", (F.least("by_a", "by_b") / F.col("total")).alias("consistent"))
    return (found.join(agreed, ["text_key", "item_id"], "left")
            .select("text_key", "item_id", "covered", "run", F.coalesce("consistent", F.lit(1.0)).alias("consistent"))
            .where(F.col("consistent") >= CONSISTENT).unionByName(exact))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with `contaminated` and `items` (the ids found, sorted; empty if none), replacing columns of these names.

    A text holds an item if it has 60 % of the item's windows, or 9 of them in a row. Equal texts are looked at
    once. Null texts hold nothing; every row of docs is returned, with all its other columns. Ids of items may be of any
    type that can be ordered.
    """
    keyed = docs.drop("contaminated", "items").withColumn("__text_key", F.md5(F.coalesce(F.col("text"), F.lit(""))))
    found = settle(find_items(keyed.select(F.col("__text_key").alias("text_key"), "text"), benchmark), "items-found")
    of_text = found.groupBy(F.col("text_key").alias("__text_key")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    none = F.array().cast(of_text.schema["items"].dataType)
    return (keyed.join(of_text, "__text_key", "left").withColumn("contaminated", F.col("items").isNotNull())
            .withColumn("items", F.coalesce("items", none)).drop("__text_key"))
