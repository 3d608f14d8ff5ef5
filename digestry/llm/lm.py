"""Log-bilinear language model, trained by noise-contrastive estimation, and its normalised scores of whole texts.

A context word's vector times a target word's vector plus the target's bias is the target's log-score. Training never
normalises: it tells words of the corpus from noise words. Afterwards batched matrix products sum each context's
scores over the vocabulary once, so every token's probability is normalised at the price of one dot product.

What is learned follows the corpus: word counts come from all training texts, the number of words with vectors of
their own grows with the corpus, and every task trains on all of its texts. Tasks' parameters are averaged row by row,
weighted by how often each task met the row, so a word of few tasks keeps all that these learned. Words without a vector
of their own are predicted by classes of word endings and share a class's probability by their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from digestry.llm.words import Lookup, as_signed, words
from digestry.session import settle

END = np.int64(0x0E4D)  # stands for the end of a text among word hashes

VOCABULARY = 4        # words with a vector of their own, times the root of the number of training tokens
LEAST_VOCABULARY = 1024
CLASSES = 256         # of the endings of all other words
KNOWN_WORDS = 1 << 18  # words whose counts go to every task, about, if not more have vectors; the others' counts are joined
SHARE_TOKENS = 8_000_000  # tokens that one task learns from, at least, if there are as many
DIMENSIONS = 16
NOISE = 32
BATCH = 640
RATE = 0.15
ROUNDS = 2
SHARE = 0.9           # of the neural model; the rest is the smoothed unigram model, so no word is hopeless
CHUNK = 1 << 17       # bytes of texts in hand, so that what is made of them stays near
HELD_ROWS = 500_000   # rows of parameters that a task adds up at a time


def _classes() -> np.ndarray:
    """Of each pair of a word's last byte and the one before."""
    low = np.arange(256)
    low[65:91] += 32
    return ((low[:, None] * 7919 + low * 104729) % 65521 % CLASSES).astype(np.int32).reshape(-1)


_CLASS_OF = _classes()


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first and last text, token hashes and classes with an end after each text, bounds of the texts."""
    for found in words(column, CHUNK):
        k = found.last - found.first
        bounds = found.bounds + np.arange(k + 1)
        out, classes = np.full(bounds[-1], END, np.int64), np.zeros(bounds[-1], np.int32)
        at = np.arange(len(found.hashes)) + found.owners()
        out[at] = as_signed(found.hashes)
        last, before = found.ends - 1, np.maximum(found.ends - 2, found.starts)
        classes[at] = _CLASS_OF.take(found.data.take(last).astype(np.int32) * 256 + found.data.take(before))
        yield found.first, found.last, out, classes, bounds


def word_counts(docs: DataFrame, text: str = "text", keep: int = 1_000_000) -> DataFrame:
    """(word, class, n) over all texts; tasks sum up before the shuffle, `keep` distinct words at a time."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            keys, first, at = np.unique(np.concatenate([k for k, *_ in seen]), return_index=True, return_inverse=True)
            return keys, np.concatenate([c for _, c, _ in seen])[first], np.bincount(at, np.concatenate([n for *_, n in seen])).astype(np.int64)

        held = 0
        for batch in batches:
            for *_, tokens, classes, _ in _tokens(batch.column(0)):
                keys, first, n = np.unique(tokens, return_index=True, return_counts=True)
                seen.append((keys, classes[first], n))
                held += len(seen[-1][0])
                if held >= keep:
                    seen = [merged()]
                    held = len(seen[0][0])
                    if held >= keep // 2:
                        yield pa.RecordBatch.from_arrays(list(map(pa.array, seen.pop())), ["word", "class", "n"])
                        held = 0
        if seen:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, merged())), ["word", "class", "n"])

    return (docs.select(F.col(text).cast("string")).mapInArrow(count, "word long, class int, n long")
            .groupBy("word").agg(F.max("class").alias("class"), F.sum("n").alias("n")))


@dataclass
class Counts:
    """Most frequent words (sorted by hash) with their counts and classes; tokens and distinct words of all; of each class
    the sum of count + 1 over all its words."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    tokens: int
    types: int
    of_class: np.ndarray

    @property
    def vocabulary(self) -> int:
        return _vocabulary(self.tokens)


def _vocabulary(tokens: int) -> int:
    return max(LEAST_VOCABULARY, int(VOCABULARY * tokens ** 0.5))


def frequent(counts: DataFrame, most: int = KNOWN_WORDS) -> Counts:
    """Words above the least count that leaves at most `most` of them, or as many as have vectors if these are more. Only
    these come to the driver."""
    level = F.floor(16 * F.log2("n")).cast("int")
    levels = sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("types"), F.sum("n").alias("n")).collect(), reverse=True)
    taken, least, most = 0, None, max(most, _vocabulary(sum(r.n for r in levels)))
    for row in levels:
        if taken + row.types > most:
            break
        taken, least = taken + row.types, row.level
    known = counts.where(level >= least).toArrow() if least is not None else None
    keys = known.column("word").to_numpy() if known else np.zeros(0, np.int64)
    order, of_class = np.argsort(keys), np.zeros(CLASSES, np.int64)
    for row in counts.groupBy("class").agg(F.sum(F.col("n") + 1).alias("n")).collect():  # at most CLASSES
        of_class[row["class"]] = row.n
    return Counts(keys[order], known.column("n").to_numpy()[order] if known else keys, known.column("class").to_numpy()[order] if known else keys.astype(np.int32),
                  sum(r.n for r in levels), sum(r.types for r in levels), of_class)


@dataclass
class LogBilinear:
    """Vectors of contexts and targets, and biases. The last CLASSES targets are those of all other words; contexts add the
    text's start."""

    words: np.ndarray     # sorted hashes of all known words
    ids: np.ndarray       # their ids as targets
    mass: np.ndarray      # count + 1 of each target; of a class with one more for words never seen
    log_noise: np.ndarray  # log of the unigram probability of each target
    context: np.ndarray
    target: np.ndarray
    bias: np.ndarray

    @property
    def start(self) -> int:
        return len(self.target)

    @property
    def own(self) -> int:
        """Words with a vector of their own."""
        return len(self.target) - CLASSES

    def copy(self) -> "LogBilinear":
        return replace(self, context=self.context.copy(), target=self.target.copy(), bias=self.bias.copy())

    def finder(self) -> Lookup:
        """Of each known word its place; far quicker to ask than the sorted hashes, and made once in a task."""
        return Lookup(self.words, np.arange(len(self.words), dtype=np.int32))

    def of_tokens(self, tokens: np.ndarray, classes: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """`places` of the tokens, if known: -1 for other words."""
        places = self.finder().get(tokens, np.int32(-1)) if places is None else places
        return np.where(places >= 0, self.ids.take(places, mode="wrap") if len(self.ids) else 0, self.own + classes).astype(np.int32, copy=False)


def normalisers(spark: SparkSession, model: LogBilinear, rows: int = 256) -> np.ndarray:
    """Log of the sum over all targets for each context, in parallel by blocks of contexts."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(0).to_numpy():
                scores = model.context[block * rows:(block + 1) * rows] @ model.target.T + model.bias
                top = scores.max(1)
                found = top + np.log(np.exp(scores - top[:, None]).sum(1, dtype=np.float64))
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([found.tolist()])], ["block", "sums"])

    blocks = -(-len(model.context) // rows)
    found = spark.range(0, blocks, 1, max(1, min(blocks, spark.sparkContext.defaultParallelism))).mapInArrow(sums, "block long, sums array<double>").collect()
    return np.concatenate([r.sums for r in sorted(found)])


def untrained(counts: Counts, dimensions: int = DIMENSIONS) -> LogBilinear:
    """Starts as the unigram model: the biases are its logarithms and the targets' vectors nearly nothing."""
    order = np.lexsort((counts.words, -counts.counts))[:counts.vocabulary]
    k = len(order)
    ids = (k + counts.classes).astype(np.int32)
    ids[order] = np.arange(k)
    rest = counts.of_class - np.bincount(counts.classes[order], counts.counts[order] + 1.0, CLASSES) + 1
    mass = np.concatenate([counts.counts[order] + 1.0, rest])
    log_noise = np.log(mass / mass.sum()).astype(np.float32)
    random = np.random.default_rng(17)
    return LogBilinear(counts.words, ids, mass, log_noise, random.normal(0, 0.5, (k + CLASSES + 1, dimensions)).astype(np.float32),
                       random.normal(0, 0.01, (k + CLASSES, dimensions)).astype(np.float32), log_noise.copy())


def _bounded(x: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(x, -30, out=x), 30, out=x)


def _before(ids: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[bounds[:-1]] = start
    return out


def _summed(rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by key."""
    # Keys are numbers of rows, so key and place fit one number, whose plain sort is quicker than a stable one of the keys.
    bits = len(keys).bit_length()
    both = np.sort((keys.astype(np.int64) << bits) + np.arange(len(keys)))
    keys, order = both >> bits, both & ((1 << bits) - 1)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(rows.take(order, 0), at, axis=0)


class _Trainer:
    """Adaptive gradient steps on one task's tokens."""

    def __init__(self, model: LogBilinear, rate: float) -> None:
        self.model, self.rate = model.copy(), rate
        m = self.model
        self.met = [np.zeros(len(x), np.int64) for x in (m.context, m.target)]
        self.past = [np.full(x.shape, 1e-1, np.float32) for x in (m.context, m.target, m.bias)]
        noise = np.exp(m.log_noise.astype(np.float64))
        self.edges, self.random = np.cumsum(noise / noise.sum()), np.random.default_rng(23)
        self.drawn: list[np.ndarray] = []

    def _move(self, which: int, keys: np.ndarray, slope: np.ndarray) -> None:
        values = (self.model.context, self.model.target, self.model.bias)[which]
        past = self.past[which].take(keys, 0)
        past += slope * slope
        self.past[which][keys] = past
        slope *= self.rate
        slope /= np.sqrt(past, out=past)
        values[keys] = np.subtract(values.take(keys, 0), slope, out=slope)

    def step(self, before: np.ndarray, after: np.ndarray) -> None:
        m, n = self.model, len(after)
        noise = np.minimum(np.searchsorted(self.edges, self.random.random(NOISE)), len(self.edges) - 1)
        h, t, z = m.context.take(before, 0), m.target.take(after, 0), m.target.take(noise, 0)
        shift = np.float32(np.log(NOISE))
        real = np.einsum("ij,ij->i", h, t) + m.bias.take(after) - m.log_noise.take(after) - shift
        fake = h @ z.T
        fake += m.bias[noise] - m.log_noise[noise] - shift
        lack = -1 / (1 + np.exp(_bounded(real)))
        # In place from here on: these are the largest arrays of a step.
        excess = np.negative(_bounded(fake), out=fake)
        np.exp(excess, out=excess)
        excess += 1
        np.divide(1, excess, out=excess)
        slope_h = excess @ z
        slope_h += lack[:, None] * t
        slope_t = np.empty((n + NOISE, h.shape[1] + 1), np.float32)
        np.multiply(lack[:, None], h, out=slope_t[:n, :-1])
        slope_t[:n, -1], slope_t[n:, :-1], slope_t[n:, -1] = lack, excess.T @ h, excess.sum(0)
        keys, slope_t = _summed(slope_t, np.concatenate([after, noise]))
        scale = np.float32(1 / np.sqrt(n))
        self._move(1, keys, slope_t[:, :-1] * scale)
        self._move(2, keys, slope_t[:, -1] * scale)
        keys, slope_h = _summed(slope_h, before)
        slope_h *= scale
        self._move(0, keys, slope_h)
        self.drawn.append(noise)

    def learn(self, before: np.ndarray, after: np.ndarray, size: int) -> None:
        """Steps of `size` tokens; the last one takes what is left."""
        for at in range(0, len(after), size):
            self.step(before[at:at + size], after[at:at + size])
        for met, rows in zip(self.met, (before, np.concatenate([after, *self.drawn]))):
            met += np.bincount(rows, minlength=len(met))
        self.drawn = []

    def rows(self, start: LogBilinear) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, times met and change of the rows met: of contexts, then of targets, the latter with their bias. Changes
        are small, so half precision is enough for them."""
        m, at = self.model, [np.flatnonzero(x) for x in self.met]
        context = m.context[at[0]] - start.context[at[0]]
        moved = [np.column_stack([context, np.zeros(len(context), np.float32)]),
                 np.column_stack([m.target[at[1]] - start.target[at[1]], m.bias[at[1]] - start.bias[at[1]]])]
        return (np.concatenate([at[0], at[1] + len(m.context)]), np.concatenate([x[i] for x, i in zip(self.met, at)]),
                np.concatenate(moved).astype(np.float16))


def _blobs(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    rows = np.ascontiguousarray(rows)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (rows.shape[1] * rows.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])


def _averaged(docs: DataFrame, model: LogBilinear, rate: float) -> LogBilinear:
    """One pass over all texts: every task trains from the same start; changes of rows are averaged over the tasks that met them."""
    width = model.context.shape[1] + 1

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, find = _Trainer(model, rate), model.finder()
        left = [np.zeros(0, np.int32), np.zeros(0, np.int32)]
        for batch in batches:
            for *_, tokens, classes, bounds in _tokens(batch.column(0)):
                ids = model.of_tokens(tokens, classes, find.get(tokens, np.int32(-1)))
                left = [np.concatenate([left[0], _before(ids, bounds, model.start)]), np.concatenate([left[1], ids])]
                at = len(left[1]) // BATCH * BATCH
                trainer.learn(left[0][:at], left[1][:at], BATCH)
                left = [x[at:] for x in left]
        trainer.learn(*left, BATCH)
        row, met, values = trainer.rows(model)
        for at in range(0, len(row), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(row[at:at + 10_000]), pa.array(met[at:at + 10_000]), _blobs(values[at:at + 10_000])], ["row", "met", "part"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _summed(np.concatenate([v for _, v in held]), np.concatenate([k for k, _ in held]))

        for batch in batches:
            met = batch.column(1).to_numpy().astype(np.float64)[:, None]
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(-1, width)
            held.append((batch.column(0).to_numpy(), np.column_stack([values * met, met])))
            if sum(len(k) for k, _ in held) > HELD_ROWS:
                held = [merged()]
        if held:
            keys, sums = merged()
            yield pa.RecordBatch.from_arrays([pa.array(keys), _blobs((sums[:, :-1] / sums[:, -1:]).astype(np.float32))], ["row", "part"])

    parts = docs.mapInArrow(train, "row long, met long, part binary").repartition("row").mapInArrow(average, "row long, part binary")
    found = parts.toArrow()  # the size of one model
    out, n = model.copy(), len(model.context)
    row = found.column("row").to_numpy()
    values = np.frombuffer(b"".join(found.column("part").to_pylist()), np.float32).reshape(-1, width)
    ours = row < n
    out.context[row[ours]] += values[ours, :-1]
    out.target[row[~ours] - n] += values[~ours, :-1]
    out.bias[row[~ours] - n] += values[~ours, -1]
    return out


def train(docs: DataFrame, counts: Counts, text: str = "text", rounds: int = ROUNDS, rate: float = RATE) -> LogBilinear:
    """Splits of few tokens are brought together, for a task that learns from little teaches little."""
    model = untrained(counts)
    texts = docs.select(F.col(text).cast("string")).coalesce(max(1, -(-counts.tokens // SHARE_TOKENS)))
    for i in range(rounds):
        model = _averaged(texts, model, rate / (1 + i))
    return model


def score(docs: DataFrame, learn: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs (doc_id, text).

    Rows where `learn` holds teach the model, the others are held out; scores are log10 probabilities of whole texts.
    Null texts are empty and have one token, the end. A null doc_id stays null. Without any training row, counts are
    zero and every token has the probability of an unseen word. What tasks learn depends a little on which texts they
    get, so `score` does on the layout of the table; all other columns do not.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(learn, F.lit(False)).alias("learn"))
    lessons = rows.where("learn")
    counts = settle(word_counts(lessons), "word-counts")
    known = frequent(counts)
    model = train(lessons, known)
    norms, total = normalisers(docs.sparkSession, model), float(known.tokens + known.types + 1)
    # With an unseen word in each class, all words' probabilities add up to one.
    total_here = total + CLASSES - 1
    # The last one, of place -1, is that of all other words.
    logs = np.append(np.log10(known.counts.astype(np.int64) + 1), 0.0)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, find = TaskContext.get().partitionId(), 0, model.finder()
        for batch in batches:
            for first, last, tokens, classes, bounds in _tokens(batch.column(1)):
                places = find.get(tokens, np.int32(-1))
                ids = model.of_tokens(tokens, classes, places)
                before = _before(ids, bounds, model.start)
                dot = np.einsum("ij,ij->i", model.context.take(before, 0), model.target.take(ids, 0)).astype(np.float64)
                neural = np.exp(dot + model.bias.take(ids) - norms.take(before))
                # Both parts hold (count + 1) as a factor; where the count is not known here it is joined later. The words
                # of a class share its probability by their counts.
                share = SHARE * neural / model.mass.take(ids) + (1 - SHARE) / total_here
                own = logs.take(places, mode="wrap")
                tail = np.flatnonzero(places < 0)
                edges = np.searchsorted(tail, bounds)
                n, starts = last - first, bounds[:-1]
                own_sums = np.add.reduceat(own, starts)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n)),
                    batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(np.diff(bounds)),
                    pa.array(np.add.reduceat((places >= 0).astype(np.int64), starts)), pa.array(own_sums - np.diff(bounds) * np.log10(total)),
                    pa.array(own_sums + np.add.reduceat(np.log10(share), starts)),
                    pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(tokens[tail]))],
                    ["part", "row", "doc_id", "learn", "n_tokens", "n_known", "base_score", "score", "tail"])
                at += n

    scored = settle(rows.mapInArrow(rate, "part long, row long, doc_id long, learn boolean, n_tokens long, n_known long, "
                                          "base_score double, score double, tail array<long>"), "scored")
    rare = (scored.where("size(tail) > 0").select("part", "row", F.explode("tail").alias("word")).join(counts, "word")
            .groupBy("part", "row").agg(F.count("*").alias("more"), F.sum(F.log10(F.col("n") + 1)).alias("gain")))
    gain = F.coalesce("gain", F.lit(0.0))
    return (scored.drop("tail").join(rare, ["part", "row"], "left")
            .select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens",
                    (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("long").alias("train_tokens"),
                    (F.col("base_score") + gain).alias("base_score"), (F.col("score") + gain).alias("score")))
