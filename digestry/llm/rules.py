"""Quality rules on documents and on their hosts.

A document's own rules are counts over its whole text. What share of a host's documents fail a rule is an estimate, poor
for small hosts, so it is drawn towards all hosts' rate by a beta prior fitted to the hosts themselves. Verdicts on
hosts go back to their documents. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.session import settle

WINDOW = 8              # words of a passage that counts as repeated
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BLOCKED = 0.5           # a host whose shrunk rate of any rule is above this loses all its documents
WATCHED = 0.2           # a host above this, and above WORSE times the rate of all hosts, loses those that fail the rule
WORSE = 2.0
LEAST, MOST = 1.0, 1e6  # limits of the prior's strength, in documents
SENT_HOSTS = 100_000    # hosts with a verdict that may be sent to all tasks; more are joined by shuffle
SALTS = 32              # parts of a host's documents in that join


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def word_list(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _repeats(words: Column, window: int) -> Column:
    """How many words are in a window of `window` words that the list has twice or more. Windows are compared by 64-bit
    hashes of their words' 64-bit hashes."""
    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = bind(placed, lambda s: F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | F.coalesce(F.get(s, j + 1)["h"] == e["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda e: e["i"]))
        fresh = F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct(
            (a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end")))
        return fresh["n"]

    def counted(hashed: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(hashed) - window + 1), lambda i: F.xxhash64(F.slice(hashed, i, F.lit(window))))
        return bind(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return bind(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) <= window, 0).otherwise(counted(h)))


def facts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words), all long, from whole texts.

    Lines are those with a word; a line that equals an earlier one is a duplicate. Null texts are empty.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    read = docs.select("doc_id", "source", text.alias("text")).select(
        "doc_id", "source",
        bind(word_list(F.col("text")), lambda w: F.struct(F.size(w).alias("n_words"), _repeats(w, WINDOW).alias("n_repeat_words"))).alias("w"),
        bind(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("x"),
        F.length(F.translate("text", SPACES, "")).alias("word_chars"), (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"))
    return read.select("doc_id", "source", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in (
        "w.n_words", "word_chars", "n_symbols", "x.n_lines", "x.n_dup_lines", "w.n_repeat_words")])


#: Rules over `facts`; a document fails those that hold. The first two alone reject it.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 3 * n_words or word_chars > 10 * n_words",
}
BASE = ("few_words", "repeats")


def prior_strength(n: float, k: int, squares: float, failed: float, within: float) -> float:
    """Documents that the prior is worth, from the hosts' spread (analysis of variance of a proportion).

    n documents of k hosts, `squares` the sum of their squared sizes, `failed` documents failing, `within` the sum of
    failed * (size - failed) / size over hosts. Hosts that spread no more than chance get the strongest prior.
    """
    if k < 2 or n <= k:
        return LEAST
    mean = failed / n
    between = max(n * mean * (1 - mean) - within, 0.0) / (k - 1)  # sums of squares add up to n * mean * (1 - mean)
    inside = within / (n - k)
    usual = (n - squares / n) / (k - 1)
    whole = between + (usual - 1) * inside
    rho = (between - inside) / whole if whole > 0 else 0.0
    return MOST if rho <= 0 else min(max((1 - rho) / rho, LEAST), MOST)


def host_verdicts(failures: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(host, n, rates, blocked, watched) of every host of failures (host, one boolean for each rule).

    rates: the shrunk rate of each rule. watched: rules that its documents have to pass.
    """
    hosts = settle(failures.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.col(r)).alias(r) for r in rules]), "hosts")
    within = [F.sum(F.col(r) * (F.col("n") - F.col(r)) / F.col("n")).alias(f"{r}_within") for r in rules]
    total = hosts.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n").cast("double") ** 2).alias("squares"),
                      *[F.sum(r).alias(r) for r in rules], *within).first()
    rates, watched = [], []
    for rule in rules:
        mean = total[rule] / total["n"] if total["n"] else 0.0
        strength = prior_strength(total["n"], total["k"], total["squares"], total[rule], total[f"{rule}_within"]) if total["n"] else LEAST
        rate = (F.col(rule) + mean * strength) / (F.col("n") + strength)
        rates.append(rate.alias(rule))
        watched.append(F.when(rate > max(WATCHED, WORSE * mean), rule))
    shrunk = hosts.select("host", "n", F.struct(*rates).alias("rates"), F.array_compact(F.array(*watched)).alias("watched"))
    return shrunk.select("host", "n", "rates", (F.greatest(*[F.col(f"rates.{r}") for r in rules], F.lit(0.0)) > BLOCKED).alias("blocked"), "watched")


def apply_rules(docs: DataFrame, rules: dict[str, str] = RULES, sent_hosts: int = SENT_HOSTS) -> DataFrame:
    """The columns of `facts` of every row of docs (doc_id, text, source), with `failed` (names of rules), `base_failed`,
    `host_blocked`, `host_watched` (the failed rules that its host is watched for) and `kept`.

    kept: neither a base rule failed, nor is the host blocked, nor does it fail a rule for which its host is watched. A
    host is a `source`; rows without one are a host of their own. Repeated ids are rows of their own, further columns
    are left out, an empty table gives no rows.
    """
    found = settle(facts(docs), "facts")
    host = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit(""))
    judged = found.withColumn("host", host).select("*", *[F.coalesce(F.expr(rule), F.lit(False)).alias(name) for name, rule in rules.items()])
    verdicts = host_verdicts(judged.select("host", *rules), rules)
    bad = settle(verdicts.where(F.col("blocked") | (F.size("watched") > 0)).select("host", "blocked", "watched"), "bad-hosts")
    if bad.count() <= sent_hosts:
        joined = judged.join(F.broadcast(bad), "host", "left")
    else:
        salted = judged.withColumn("salt", F.pmod(F.xxhash64("doc_id", "word_chars"), F.lit(SALTS)))
        joined = salted.join(bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))), ["host", "salt"], "left")
    failed = F.array_compact(F.array(*[F.when(F.col(r), r) for r in rules]))
    out = joined.select(*found.columns, failed.alias("failed"), F.exists(failed, lambda r: r.isin(*BASE)).alias("base_failed"),
                        F.coalesce("blocked", F.lit(False)).alias("host_blocked"),
                        F.array_intersect(failed, F.coalesce("watched", F.array().cast("array<string>"))).alias("host_watched"))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_blocked") & (F.size("host_watched") == 0))
