"""Which tokens of two tokenizers stand for the same bytes of a text.

Both tokenizers cut the same bytes, so their tokens are intervals. All intervals, sorted by start, fall into groups
where a start reaches the running maximum of the ends before it; only tokens of one group overlap. Corpus-wide counts of
id pairs say how firmly two ids belong together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.llm.packing import Tokens, numbered_in_order
from digestry.llm.words import chunks
from digestry.session import settle

CHUNK_BYTES = 1 << 18
FREQUENT = 1 << 15  # pairs, the most frequent ones, whose counts every task gets; all others are joined
_B_BITS = 20        # a pair is one number: the A id, then the B id in so many bits


@dataclass
class Side:
    """One tokenizer: ids of a text, and the bytes of every id."""

    encode: Callable[[str], np.ndarray]
    bytes_of: list[bytes]

    def __post_init__(self) -> None:
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)

    def fits(self, ids: np.ndarray, raw: bytes) -> bool:
        return b"".join([self.bytes_of[i] for i in ids.tolist()]) == raw


def byte_side(name: str, fits: bool | None = None) -> Side:
    """A byte-level file of `tokenizers`; the text gets a space in front."""
    tokens = Tokens(name, fits=fits)
    return Side(lambda text: tokens.encode(" " + text), tokens.bytes_of)


def piece_side(name: str) -> Side:
    """A sentencepiece model that puts the space in front itself; U+2581 stands for a space, <0xHH> for a byte."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    bytes_of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
    return Side(lambda text: np.array(model.encode(text, num_threads=1), np.int64), bytes_of)


def coalesce(starts: np.ndarray, ends: np.ndarray, side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): intervals by start, A before B, and the number of the group of each in that order."""
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(breaks) - 1


def overlaps(a_starts: np.ndarray, a_ends: np.ndarray, b_starts: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in A, place in B) of tokens that share a byte; each side's tokens follow each other."""
    low = np.searchsorted(b_ends, a_starts, "right")
    n = np.searchsorted(b_starts, a_ends, "left") - low
    at = np.repeat(np.arange(len(n)), n)
    return at, np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + low[at]


def aligned(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", ending: bool = True) -> DataFrame:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) after the columns of docs but `text`, its last one.

    pairs are the text's distinct linked ids as numbers, ascending, times how often each is linked. Linked are tokens
    that share a byte; with `ending` only those of them that end together. A text that is null or empty, or whose tokens
    do not give back its bytes, has no tokens: zeros, no pairs and an empty groups_sha256. Texts are worked on in chunks;
    the longest sets the memory needed.
    """

    fits = numbered_in_order(a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = byte_side(a, fits), piece_side(b)
        # Ids as written, behind the mark that comes before them: A next or first in a group, B next or first in it.
        marked = [m + str(i) for m, s in ((",", left), (";", left), (",", right), ("|", right)) for i in range(len(s.bytes_of))]
        base = np.cumsum([0, len(left.bytes_of), len(left.bytes_of), len(right.bytes_of)])
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            for first, last, _, _ in chunks(text, CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([c.slice(first, last - first) for c in batch.columns[:-1]] + judged(text.slice(first, last - first).to_pylist(), left, right, marked, base),
                                                 names=[*batch.schema.names[:-1], *_FOUND])

    def judged(texts: list[str | None], left: Side, right: Side, marked: list[str], base: np.ndarray) -> list[pa.Array]:
        counts = np.zeros((4, len(texts)), np.int64)
        digests, pairs, times = [""] * len(texts), [np.zeros(0, np.int64)] * len(texts), [np.zeros(0, np.int64)] * len(texts)
        for k, text in enumerate(texts):
            if not text:
                continue
            ids_a, ids_b, raw = np.asarray(left.encode(text), np.int64), right.encode(text), b" " + text.encode()
            if not (left.fits(ids_a, raw) and right.fits(ids_b, raw)):
                continue
            ends_a, ends_b = np.cumsum(left.lengths[ids_a]), np.cumsum(right.lengths[ids_b])
            starts_a, starts_b = ends_a - left.lengths[ids_a], ends_b - right.lengths[ids_b]
            side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
            order, group = coalesce(np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b]), side)
            # Written group by group, A before B.
            by = np.lexsort((side[order], group))
            group, order = group[by], order[by]
            s = side[order]
            opens = np.ones(len(order), bool)
            opens[1:] = (group[1:] != group[:-1]) | (s[1:] != s[:-1])
            codes = np.concatenate([ids_a, ids_b])[order] + base[2 * s + opens]
            digests[k] = hashlib.sha256("".join([marked[c] for c in codes.tolist()])[1:].encode()).hexdigest()
            at_a, at_b = overlaps(starts_a, ends_a, starts_b, ends_b)
            if ending:
                both = ends_a[at_a] == ends_b[at_b]
                at_a, at_b = at_a[both], at_b[both]
            counts[:, k] = len(ids_a), len(ids_b), group[-1] + 1, len(at_a)
            pairs[k], times[k] = np.unique(ids_a[at_a] << _B_BITS | ids_b[at_b], return_counts=True)
        bounds = pa.array(np.cumsum([0, *map(len, pairs)]), pa.int32())
        return [*map(pa.array, counts), pa.array(digests, pa.string()), *(pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(x))) for x in (pairs, times))]

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields[:-1])
    return docs.mapInArrow(run, f"{kept}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


_FOUND = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")


def pair_parts(pair: Column) -> tuple[Column, Column]:
    """A id and B id of a pair."""
    return F.shiftright(pair, _B_BITS), pair.bitwiseAND((1 << _B_BITS) - 1)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): in how many links of all texts an id pair is, and whether no pair of its B id is in more."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("p.pairs", "p.times")
    counts = settle(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n")), "pairs").withColumn("__b", pair_parts(F.col("pair"))[1])
    top = counts.groupBy("__b").agg(F.max("n").alias("top"))
    return settle(counts.join(top, "__b").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "counts")


def looked_up(found: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """found with count_sum, the counts of its links summed up, and n_best, how many of its links are `best`; its columns
    `key`, which tells rows apart, pairs and times are used.

    The most frequent pairs, a fixed number of them, are looked up within the task; what is left, whose every pair is
    then at most one in `frequent` of all links, is joined.
    """
    top = counts.orderBy(F.desc("n"), "pair").limit(frequent).toPandas().sort_values("pair")
    known, n, best = top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64), top["best"].to_numpy(bool)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            lists = batch.column(names.index("pairs"))
            bounds = lists.offsets.to_numpy()
            pairs, times = lists.values.to_numpy()[bounds[0]:bounds[-1]], batch.column(names.index("times")).flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(bounds))
            at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[at] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = np.zeros((2, len(lists)), np.int64)
            for row, worth in zip(sums, (n, best)):
                np.add.at(row, owner[hit], times[hit] * worth[at[hit]])
            rest = pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner[~hit], minlength=len(lists)))]), pa.int32())
            kept = [batch.column(i) for i, c in enumerate(names) if c not in ("pairs", "times")]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, sums), *(pa.ListArray.from_arrays(rest, pa.array(x[~hit])) for x in (pairs, times))],
                                             names=[*(c for c in names if c not in ("pairs", "times")), "count_sum", "n_best", "pairs", "times"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema if f.name not in ("pairs", "times"))
    near = settle(found.mapInArrow(look, f"{kept}, count_sum long, n_best long, pairs array<long>, times array<long>"), "looked-up")
    rest = near.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("key", F.col("p.pairs").alias("pair"), "p.times")
    rest = (rest.join(counts, "pair").groupBy("key")
            .agg(F.sum(F.col("times") * F.col("n")).alias("__sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("__best")))
    return (near.drop("pairs", "times").join(rest, "key", "left")
            .withColumn("count_sum", F.col("count_sum") + F.coalesce("__sum", F.lit(0)))
            .withColumn("n_best", F.col("n_best") + F.coalesce("__best", F.lit(0))).drop("__sum", "__best"))


def align_tokens(docs: DataFrame, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model", ending: bool = True, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of docs.

    See `aligned` for links and for texts without tokens. Rows may repeat an id or have none; further columns are left
    out; an empty table gives no rows. The count of an id pair is over all rows.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", F.col("text").cast("string").alias("text"))
    found = settle(aligned(narrow, a, b, ending), "aligned")
    return looked_up(found, pair_counts(found), frequent).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
