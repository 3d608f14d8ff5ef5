"""Quality by interpolated modified Kneser-Ney n-gram models.

One model learns from trusted text, one from the same and from text known to be bad; counts and the quantities of both are joins and
groupings of n-gram tables sharded by hash. Words and frequent n-grams go to the tasks that score; documents meet all other
n-grams of the highest order by a join. Counting and joining go slice by slice of the contexts, so that little lies on disk at a
time. A document's perplexity under the trusted model, in proportion to its
perplexity under the other, is held against the tails of its language among trusted documents that neither model saw.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_, call

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from digestry.llm.words import Lookup, as_signed, mix, words
from digestry.session import discard, settle, shuffles_end_with_queries, small_batches

ORDER = 2
FREQUENT = 1_000_000  # most n-grams of the highest order that are sent to the tasks; documents are joined with the others
SLICES = 6          # rounds in which n-grams of the highest order are counted
SLICE_BYTES = 1 << 21  # least text of a round
TOGETHER = 2        # slices that meet the documents at a time
SKETCH, BLOCKS = 1 << 26, 64  # bits, in blocks, that tell most n-grams of the documents that no share waits for; never a result
UNSEEN = 0.2        # part of the trusted labelled documents kept for the thresholds
TAIL = 0.005        # part of a language's trusted documents beyond each limit
HIGH = 0.8          # quantile from which a tail is taken to fall exponentially
ERRORS = 2          # standard errors by which lower limits are wider, as no least evidence holds for them
EVIDENCE = 0.5      # least log10 by which a passage has to gain before a text is called strange, whatever the limits
WINDOW = 64         # tokens of the passage whose gains are summed up, so that a long text cannot thin them out
MIXED = 0.05        # part of a bad text's words that are taken to be of its own kind
LANGUAGES = 10_000  # limits that may be sent to all tasks; more are joined by shuffle
LEAST = 20          # measured documents of a language that make a limit of its own
SHORT = 50          # tokens at which a text's own evidence and its language's median weigh the same
START, STOP = np.uint64(0x57A7), np.uint64(0xE4D)


def _grams(column: pa.Array, order: int) -> Iterator[tuple[int, int, np.ndarray, list[np.ndarray]]]:
    """Per chunk: first and last text, bounds of the texts' tokens, and for n = 1 to `order` the hash of the n-gram that
    ends at each token; n-grams reach over at most one mark of the start."""
    for found in words(column):
        k = found.last - found.first
        bounds = found.bounds + np.arange(k + 1)
        tokens = np.full(bounds[-1], STOP, np.uint64)
        tokens[np.arange(len(found.hashes)) + found.owners()] = found.hashes
        place = np.arange(len(tokens)) - np.repeat(bounds[:-1], np.diff(bounds))
        grams = [tokens]
        with np.errstate(over="ignore"):
            for n in range(1, order):
                # The n-gram ending here prolongs the shorter one that ends at the token before it.
                before = np.roll(grams[-1], 1)
                before[place == 0] = START
                grams.append(mix(before * np.uint64(0x9E3779B97F4A7C15) + tokens + np.uint64(n)))
        yield found.first, found.last, bounds, grams


def _contexts(grams: list[np.ndarray], bounds: np.ndarray) -> list[np.ndarray]:
    """For n = 2 and up: hash of the words before each token, the context of its n-gram."""
    out = []
    for shorter in grams[:-1]:
        before = np.roll(shorter, 1)
        before[bounds[:-1]] = START
        out.append(before)
    return out


def _slice(grams: list[np.ndarray], contexts: list[np.ndarray], slices: int) -> np.ndarray:
    """In which slice the n-grams of the highest order are: all of a context in the same one."""
    return ((contexts[-1] if contexts else grams[-1]) >> np.uint64(32)) % np.uint64(slices)


def gram_counts(docs: DataFrame, order: int = ORDER, whole: bool = True, part: int = 0, slices: int = 1) -> DataFrame:
    """(g1 ... gN, c2 ... cN, n): for each n-gram of the highest order in the slice `part` its count, the hashes of all its
    endings g, and of what stands before the last word of each ending, c. Not `whole`, its own hash gN, which the others tell,
    is left out."""
    names = [f"g{n}" for n in range(1, order + 1)] + [f"c{n}" for n in range(2, order + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, bounds, grams in _grams(batch.column(0), order):
                contexts = _contexts(grams, bounds)
                mine = np.flatnonzero(_slice(grams, contexts, slices) == part)
                if len(mine):
                    _, at, n = np.unique(grams[-1][mine], return_index=True, return_counts=True)
                    columns = [pa.array(as_signed(x[mine[at]])) for x in [*grams, *contexts]]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*names, "n"])

    told = names if whole or order == 1 else [c for c in names if c != f"g{order}"]
    return (docs.select(F.col("text").cast("string")).mapInArrow(count, ", ".join(f"{c} long" for c in names) + ", n long")
            .groupBy(*told).agg(F.sum("n").alias("n")))


@dataclass
class KneserNey:
    """For each word its discounted share; per order from 2 the count of each n-gram, what to take off counts of 0, 1, 2 and
    more, and by context, as real and imaginary part, what it leaves to shorter ones and the sum of its counts.
    `rare` has the n-grams (gram, n: discounted count) of the highest order that are not among its shares, if any, by slice."""

    shares: list[Lookup]
    discounts: list[np.ndarray]
    rests: list[Lookup]
    unknown: float
    rare: list[DataFrame] | None = None

    def probability(self, grams: list[np.ndarray], contexts: list[np.ndarray], alone: np.ndarray | None = None) -> np.ndarray:
        """Of each last word after its context; `alone` without any, if that is known."""
        p = self.shares[0].get(as_signed(grams[0]), 0.0).astype(float) + self.unknown if alone is None else alone
        for n in range(1, len(grams)):
            rest = self.rests[n - 1].get(as_signed(contexts[n - 1]), 1 + 1j)
            count = self.shares[n].get(as_signed(grams[n]), 0.0)
            share = (count - self.discounts[n - 1][np.minimum(count, 3).astype(int)]) / rest.imag
            p = share.astype(np.float32) + rest.real * p
        return p

    def waiting(self, grams: list[np.ndarray], contexts: list[np.ndarray], sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which n-grams have no count in memory but may have one elsewhere, as the sketch and the model tell: it knows their context
        and word; and what each would add to its probability for every count, in proportion to the probability."""
        met = np.flatnonzero(_marked(sketch, grams[-1]))
        grams, contexts = [g[met] for g in grams], [c[met] for c in contexts]
        rest = self.rests[-1].get(as_signed(contexts[-1]), 1 + 1j)
        at = np.flatnonzero((rest.real < 1) & (self.shares[-1].get(as_signed(grams[-1]), 0.0) == 0) & (self.shares[0].get(as_signed(grams[0]), 0.0) > 0))
        rest, shorter = rest[at], self.probability([g[at] for g in grams[:-1]], [c[at] for c in contexts[:-1]])
        return met[at], (1 / (rest.imag * (rest.real * shorter))).astype(np.float32)


def _bits(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return grams & np.uint64(SKETCH - 1), (grams >> np.uint64(32)) & np.uint64(SKETCH - 1)


def _marked(sketch: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Which hashes have both bits set: all that were sketched, and few others unless the sketch is full."""
    return np.logical_and.reduce([sketch[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 for bit in _bits(grams)]).astype(bool)


def _sketch(grams: DataFrame) -> np.ndarray:
    """Both bits of every hash `gram`."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(SKETCH, bool)
        for batch in batches:
            for bit in _bits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                marks[bit] = True
        for i, block in enumerate(np.packbits(marks, bitorder="little").reshape(BLOCKS, -1)):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([block.tobytes()], pa.binary())], ["block", "bits"])

    def merge(blocks: pa.Table) -> pa.Table:
        bits = reduce(np.bitwise_or, (np.frombuffer(x.as_py(), np.uint8) for x in blocks["bits"]))
        return pa.table({"block": blocks["block"].slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary())})

    schema = "block int, bits binary"
    out = np.zeros((BLOCKS, SKETCH // 8 // BLOCKS), np.uint8)
    for row in grams.select("gram").mapInArrow(mark, schema).groupBy("block").applyInArrow(merge, schema).toArrow().to_pylist():
        out[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def _discounts(table: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more, from how many n-grams occur 1, 2, 3 and 4 times."""
    row = table.agg(*(F.sum((F.col("n") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = ((x or 0) for x in row)
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw)]


def _slices(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    return min(SLICES, 1 + size // SLICE_BYTES)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def train(docs: DataFrame, order: int = ORDER, asked: int | None = None) -> KneserNey | None:
    """The model of all documents given, with the n-grams up to the order `asked` only if that is lower; None if there are none."""
    shares: list[Lookup] = []
    discounts: list[np.ndarray] = []
    rests: list[Lookup] = []
    rare = None
    asked = min(order, asked or order)
    slices = _slices(docs)
    tables = (settle(gram_counts(docs, order, asked == order, k, slices), "counted") for k in range(slices))
    for n in range(order, 1, -1):
        lower = [f"g{k}" for k in range(1, n)] + [f"c{k}" for k in range(2, n)]
        own, contexts, below = [], [], []
        for table in tables:
            if n <= asked:
                own.append(settle(table.select(F.col(f"g{n}").alias("gram"), "n"), "grams"))
                contexts.append(settle(table.groupBy(F.col(f"c{n}").alias("context")).agg(
                    F.sum("n").alias("total"), *(F.sum(x.cast("long")).alias(f"k{i}") for i, x in enumerate((F.col("n") == 1, F.col("n") == 2, F.col("n") > 2)))), "contexts"))
            # Lower orders count different words before an n-gram, not occurrences.
            below.append(settle(table.groupBy(*lower).agg(F.count("*").alias("n")), "below"))
            discard(table)
        tables = [settle(_union(below).groupBy(*lower).agg(F.sum("n").alias("n")), "counted")]
        discard(*below)
        if n > asked:
            continue
        d = _discounts(_union(own))
        least = _least_frequent(_union(own)) if n == asked else 1
        if least > 1:
            rare = [x.where(F.col("n") < least).select("gram", _discounted(d).alias("n")) for x in own]
        shares.insert(0, _collected(_union(own).where(F.col("n") >= least).select("gram", F.col("n").cast("float"))))
        discounts.insert(0, np.array([0.0, *d]))
        spared = sum(F.col(f"k{i}") * d[i] for i in range(3))
        rests.insert(0, _collected(_union(contexts).select("context", (spared / F.col("total")).cast("float"), F.col("total").cast("float"))))
        discard(*contexts, *(own if least == 1 else []))
    tables = list(tables)
    table = _union(tables)
    d = _discounts(table)
    whole = table.agg(F.sum("n").alias("total"), F.sum(F.col("n") - _discounted(d)).alias("spared")).first()
    shares.insert(0, _collected(table.select("g1", (_discounted(d) / F.lit(whole.total)).cast("float"))))
    discard(*tables)
    kinds = len(shares[0].keys)
    return KneserNey(shares, discounts, rests, float(whole.spared) / whole.total / (kinds + 1), rare) if kinds else None


def _collected(rows: DataFrame) -> Lookup:
    """Values by key, of rows (key, real[, imaginary]). The driver holds them once, but for one column at a time."""
    table = rows.toArrow()
    keys, values = table.column(0).to_numpy(), np.empty(table.num_rows, np.float32 if table.num_columns == 2 else np.complex64)
    for part, i in zip((values.real, values.imag), range(1, table.num_columns)):
        part[:] = table.column(i).to_numpy()
    del table
    pa.default_memory_pool().release_unused()
    return Lookup(keys, values)


def _discounted(d: list[float]) -> Column:
    """A count less its discount."""
    n = F.col("n")
    return n - F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _least_frequent(counted: DataFrame) -> int:
    """The least count from which at most FREQUENT n-grams are left."""
    total = 0
    for row in counted.groupBy("n").agg(F.count("*").alias("kinds")).orderBy(F.desc("n")).toLocalIterator():
        total += row.kinds
        if total > FREQUENT:
            return row.n + 1
    return 1


def _peaks(gain: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each text the largest sum of WINDOW values in a row; a shorter text is one passage."""
    sums = np.concatenate([[0.0], np.cumsum(gain)])
    first, last = np.repeat(bounds[:-1], np.diff(bounds)), np.repeat(bounds[1:], np.diff(bounds))
    at = np.arange(len(gain))
    passages = sums[np.minimum(at + WINDOW, last)] - sums[at]
    passages[(at + WINDOW > last) & (at > first)] = -np.inf
    return np.maximum.reduceat(passages, bounds[:-1])


class _ByValue:
    """What a broadcast of it holds in tasks is the value itself, though they may lack this module. Its bytes are made when it is sent."""

    def __init__(self, value: object) -> None:
        self.value = value

    def __reduce__(self) -> tuple:
        return pickle.loads, (cloudpickle.dumps(self.value),)


class _ModelByValue(_ByValue):
    """Table by table, so that the bytes of a model never lie in memory twice."""

    def __reduce__(self) -> tuple:
        m = self.value
        return call, (_ByValue(KneserNey), [_ByValue(x) for x in m.shares], m.discounts, [_ByValue(x) for x in m.rests], m.unknown)


class Sent:
    """A model that tasks have: its bytes are sent once for all rounds, the model made once in each worker. The driver holds
    nothing of it but what tells its rare n-grams."""

    def __init__(self, spark: SparkSession, model: KneserNey | None) -> None:
        self.empty, self.rare = model is None, model and model.rare
        self.held = spark.sparkContext.broadcast(_ByValue(None) if model is None else _ModelByValue(model))


def score(docs: DataFrame, trusted: KneserNey | Sent, other: KneserNey | Sent | None, carry: tuple[str, ...], order: int = ORDER) -> DataFrame:
    """`carry` columns of docs, n_tokens (the end included), log10_trusted of each text, and gain: by how much log10 of
    its words' probabilities grow if each may come from bad text with probability MIXED (0.0 without such a model);
    peak is the largest gain of WINDOW tokens in a row, or of the whole of a shorter text; log10_other is that of the
    other model's single words, null without it."""
    at = carry.index("text") + 1 if "text" in carry else 0
    text = F.col("text").cast("string")
    key = F.xxhash64(text).alias("__key")
    rows = docs.select(F.lit(None).cast("string").alias("__text") if at else text.alias("__text"), *carry, key)
    by_slice = trusted.rare
    sent, sent_other = ((model if isinstance(model, Sent) else Sent(docs.sparkSession, model)).held for model in (trusted, other))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trusted, other = sent.value, sent_other.value
        for batch in batches:
            for first, last, bounds, grams in _grams(batch.column(at), order):
                alone = trusted.probability(grams[:1], [])
                p = trusted.probability(grams, _contexts(grams, bounds), alone)
                bad = other.probability(grams[:1], []) if other else None
                gain = np.log10(1 - MIXED + MIXED * bad / alone) if other else np.zeros(len(p))
                sums = [pa.array(np.add.reduceat(x, bounds[:-1])) for x in (np.log10(p), gain)]
                sums += [pa.array(_peaks(gain, bounds)), pa.array(np.add.reduceat(np.log10(bad), bounds[:-1])) if other else pa.nulls(last - first, pa.float64())]
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[1:]), pa.array(np.diff(bounds)), *sums],
                                                 names=[*batch.schema.names[1:], *measures])

    measures = ["n_tokens", "log10_trusted", "gain", "peak", "log10_other"]
    schema = reduce(lambda made, x: made.add(*x), zip(measures, ["long", "double", "double", "double", "double"]), StructType([*rows.schema.fields[1:]]))
    out = rows.mapInArrow(rate, schema)
    if by_slice is None:
        return out.drop("__key")
    slices = len(by_slice)

    def waiting(part: int, sketch: Broadcast) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trusted = sent.value
            for batch in batches:
                for first, last, bounds, grams in _grams(batch.column(0), order):
                    contexts = _contexts(grams, bounds)
                    mine = np.flatnonzero(_slice(grams, contexts, slices) // np.uint64(TOGETHER) == part)
                    found, more = trusted.waiting([g[mine] for g in grams], [c[mine] for c in contexts], np.frombuffer(sketch.value, np.uint8))
                    mine = mine[found]
                    keys = batch.column(1).to_numpy(zero_copy_only=False)[first:last].repeat(np.diff(bounds))[mine]
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(as_signed(grams[-1][mine])), pa.array(more)], ["__key", "gram", "more"])

        return docs.select(text, key).mapInArrow(find, "__key long, gram long, more float")

    # What the shares elsewhere add follows from the text, so equal texts are told by one key, and get the mean of theirs.
    found = [docs.groupBy(key).agg(F.count("*").alias("__n"), F.lit(0.0).alias("__more"))]
    for part in range(math.ceil(slices / TOGETHER)):
        rare = _union(by_slice[part * TOGETHER:(part + 1) * TOGETHER])
        # Of this round's n-grams only, and gone from the workers after it, so that it is a third as full.
        sketch = docs.sparkSession.sparkContext.broadcast(_sketch(rare).tobytes())
        met = waiting(part, sketch).join(rare.hint("shuffle_hash"), "gram").groupBy("__key").agg(F.sum(F.log10(1 + F.col("n") * F.col("more").cast("double"))).alias("__more"))
        found.append(settle(met.withColumn("__n", F.lit(0).cast("long")), "met"))
        sketch.destroy()
    more = settle(_union(found).groupBy("__key").agg((F.sum("__more") / F.sum("__n")).alias("__more")), "more")
    discard(*found[1:])
    return (out.join(more, "__key", "left").drop("__key")
            .withColumn("log10_trusted", F.col("log10_trusted") + F.coalesce("__more", F.lit(0.0))).drop("__more"))


def _limits(seen: DataFrame) -> tuple[DataFrame, Row]:
    """By language with at least LEAST of the trusted rows seen (lang, n_tokens, __s, __p, __o, peak), and of all
    together: medians sm, pm and om, growth of the peak with the logarithm of the length, limits top_s, top_p, low_p, low_o, top_r.

    A limit is the HIGH quantile and what an exponential tail of the same mean excess adds up to the part TAIL. Lower limits
    are wider by ERRORS standard errors of that mean. The growth is one for all languages. Measures are those of `_drawn`, so the limits fit what is held against them.
    """
    rows = settle(seen.select("n_tokens", "__s", "__p", "__o", "peak", F.explode(F.array(F.lit(None).cast("string"), "lang")).alias("lang"), F.monotonically_increasing_id().alias("i"))
                  .dropDuplicates(["i", "lang"]).drop("i"), "measured")
    middle = rows.groupBy("lang").agg(F.percentile_approx("__s", 0.5, 10_000).alias("sm"), F.percentile_approx("__p", 0.5, 10_000).alias("pm"),
                                      F.percentile_approx("__o", 0.5, 10_000).alias("om"),
                                      F.count("*").alias("n"))
    growth = seen.agg(F.regr_slope("peak", _length()).alias("g")).first().g
    middle = settle(middle.where(F.col("lang").isNull() | (F.col("n") >= LEAST)).drop("n").withColumn("growth", F.lit(max(growth or 0.0, 0.0))), "middles")
    s, p, o, r = _drawn()
    same = rows.join(middle.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).select("of", s.alias("top_s"), p.alias("top_p"), (-p).alias("low_p"), (-o).alias("low_o"), r.alias("top_r"))
    names = ("top_s", "top_p", "low_p", "low_o", "top_r")
    same = settle(same, "drawn")
    high = settle(same.groupBy("of").agg(*(F.percentile_approx(c, HIGH, 10_000).alias(f"h_{c}") for c in names)), "highs")
    over = same.join(high.withColumnRenamed("of", "lang"), F.col("of").eqNullSafe(F.col("lang"))).groupBy("of").agg(
        *(F.first(f"h_{c}").alias(f"h_{c}") for c in names), *(F.avg(F.when(F.col(c) > F.col(f"h_{c}"), F.col(c) - F.col(f"h_{c}"))).alias(f"e_{c}") for c in names),
        *(F.sum((F.col(c) > F.col(f"h_{c}")).cast("long")).alias(f"k_{c}") for c in names))
    limit = lambda c: F.col(f"h_{c}") + math.log((1 - HIGH) / TAIL) * F.coalesce(F.col(f"e_{c}") * (1 + (ERRORS if c.startswith("low") else 0) / F.sqrt(f"k_{c}")), F.lit(0.0))
    over = over.select("of", *((-limit(c) if c.startswith("low") else limit(c)).alias(c) for c in names))
    done = settle(middle.join(over, F.col("lang").eqNullSafe(F.col("of"))).drop("of"), "limits")
    return done.where("lang is not null"), done.where("lang is null").drop("lang").first() or Row(**dict.fromkeys(("sm", "pm", "om", "growth", *names)))


def _length() -> Column:
    return F.log(F.greatest(F.col("n_tokens"), F.lit(WINDOW)).cast("double"))


def _drawn() -> tuple[Column, Column, Column, Column]:
    """Strangeness and perplexity under the trusted and the other model, those of short texts drawn towards the median, and the peak without its growth."""
    n = F.col("n_tokens")
    s, p, o = ((F.col(c) - F.col(m)) * n / (n + SHORT) + F.col(m) for c, m in (("__s", "sm"), ("__p", "pm"), ("__o", "om")))
    return s, p, o, F.col("peak") - F.col("growth") * _length()


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id", "lang"), order: int = ORDER) -> DataFrame:
    """One row per document: `carry`, n_tokens, perplexity, strangeness and peak with their limits, kept. docs: (doc_id,
    lang, text), ids whole numbers, with any further columns, of which `carry` says what comes out; those named like
    one of the results do not.

    labels: (doc_id, quality, toxic). Trusted are quality 1 and not toxic; quality 0 or toxic ones teach the other
    model; several labels of a document count as the worst. The models learn from all of them, but for a part UNSEEN of
    the trusted, all of which the limits are measured on. All documents are scored whole.
    Three measures have limits by language, each with the part TAIL of unseen trusted documents beyond it: perplexity of
    the whole n-gram model, on both sides (below, only if single words are as predictable for the other model, which did
    not learn from trusted documents: these and their copies are expected to be below); strangeness, the mean gain per word of the mixture over the trusted model; and
    peak, the largest sum of gains in a passage, less what it grows with the length among trusted documents. These two
    count only if some passage gains EVIDENCE, that is, becomes three times as likely. Gains are
    taken from single words, for a rare pair that a bad text happens to share says little. The first two are drawn
    towards the language's median in texts of few words. A document beyond any limit is rejected; a language without
    enough trusted documents to measure has the limits of all together. A text without words, or any text if nothing is
    labelled trusted, has null measures and is kept.
    """
    with shuffles_end_with_queries(docs.sparkSession), small_batches(docs.sparkSession):
        return _classified(docs, labels, carry, order)


def _lessons(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text, good) of the documents that are among the chosen ids; few others have their texts shuffled."""
    key = F.xxhash64("doc_id").alias("gram")
    sent = docs.sparkSession.sparkContext.broadcast(_sketch(chosen.select(key)).tobytes())

    def among(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            yield batch.filter(pa.array(_marked(sketch, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)))).select([0, 1])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = settle(rows.select("*", key).mapInArrow(among, "doc_id long, text string").join(chosen, "doc_id"), "lessons")
    sent.destroy()
    return texts


def _classified(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...], order: int) -> DataFrame:
    judged = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    good, bad = F.expr("quality = 1 and coalesce(toxic, 0) = 0"), F.expr("quality = 0 or toxic = 1")
    roll = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < int(1000 * UNSEEN)
    chosen = settle(judged.select("doc_id", F.when(bad, False).when(good & ~roll, True).alias("good")).where("good is not null"), "chosen")
    texts = _lessons(docs, chosen)
    discard(chosen)
    # Each model goes to the tasks as soon as it is made, so the driver never holds both.
    models = [Sent(docs.sparkSession, train(texts.where("good" if i == 0 else "not good"), order, asked)) for i, asked in enumerate((None, 1))]
    discard(texts)
    own = [c for c in carry if c not in ("n_tokens", "perplexity", "perplexity_least", "perplexity_limit", "strangeness", "limit", "peak", "peak_limit", "kept")]
    if models[0].empty:
        null = F.lit(None).cast("double")
        return docs.select(*own, F.lit(None).cast("long").alias("n_tokens"), null.alias("perplexity"), null.alias("perplexity_least"), null.alias("perplexity_limit"),
                           null.alias("strangeness"), null.alias("limit"), null.alias("peak"), null.alias("peak_limit"), F.lit(True).alias("kept"))
    n = F.col("n_tokens")
    # Under names of their own, so that none meets a name used here; the text stays the one that is read.
    held_as = {c: "text" if c == "text" else f"__c{i}" for i, c in enumerate(own)}
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text", *[F.col(c).alias(n) for c, n in held_as.items() if c != "text"])
    scored = score(named, models[0], models[1], ("doc_id", "lang", *held_as.values()), order)
    discard(*models[0].rare or [])
    scored = settle(scored.withColumn("__s", F.when(n > 1, F.col("gain") / n)).withColumn("__p", F.when(n > 1, -F.col("log10_trusted") / n))
                    .withColumn("__o", F.when(n > 1, -F.col("log10_other") / n)), "quality")
    for model in models:
        model.held.destroy()
    seen = scored.where("__s is not null").join(judged.where(good & roll).select("doc_id"), "doc_id", "left_semi")
    of_lang, of_all = _limits(seen)
    if of_lang.count() <= LANGUAGES:
        of_lang = F.broadcast(of_lang)
    held = scored.join(of_lang, "lang", "left").withColumns({c: F.coalesce(F.col(c), F.lit(of_all[c]).cast("double")) for c in of_all.asDict()}).alias("__held")
    strange, wild, other, peak = _drawn()
    ten = F.lit(10.0)
    out = held.select(*[F.col(f"__held.{n}").alias(c) for c, n in held_as.items()], "n_tokens", F.pow(ten, wild).alias("perplexity"), F.pow(ten, "low_p").alias("perplexity_least"), F.pow(ten, "top_p").alias("perplexity_limit"),
                      strange.alias("strangeness"), F.col("top_s").alias("limit"), F.when(F.col("__s").isNotNull(), peak).alias("peak"), F.col("top_r").alias("peak_limit"),
                      ((other < F.col("low_o")) & (wild < F.col("low_p"))).alias("__dull"), (F.col("__held.peak") < EVIDENCE).alias("__weak"))
    within = [F.col("__weak") | ((F.col("strangeness") <= F.col("limit")) & (F.col("peak") <= F.col("peak_limit"))), F.col("perplexity") <= F.col("perplexity_limit"), ~F.col("__dull")]
    return out.withColumn("kept", reduce(and_, (F.coalesce(x, F.lit(True)) for x in within))).drop("__dull", "__weak")
