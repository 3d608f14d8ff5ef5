"""Packing tokenised documents into fixed-length sequences: dominance reduction, then best fit.

The plan is made from the number of pieces of each length, at most `length` numbers whatever the size of the table, and
speaks of groups of equal sequences. Placing the pieces is one join-free lookup per piece, by its rank among pieces of
its length.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from digestry.session import settle

LENGTH = 2048
RUN = 500_000  # pieces one task numbers


class Tokens:
    """Token ids of texts by a byte-level BPE file of the `tokenizers` library.

    The file's vocabulary is handed to tiktoken's encoder, which gives the same ids in a quarter of the time: there a
    token's rank is its id, so merges must be numbered in order and texts cut by the same pattern. Both are tested; a file
    of which they do not hold is used as it is (`fits`, tested once on the driver, as it takes memory). With `added`, the strings of the file's added tokens become their ids,
    as `tokenizers` does unless told otherwise; else they are ordinary text.
    """

    def __init__(self, name: str, added: bool = False, fits: bool | None = None) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(public_tokenizers.path(name))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that a vocabulary writes as themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        special = {t.content: i for i, t in made.get_added_tokens_decoder().items()}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in made.get_vocab().items() if t not in special}
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for b, i in [*ranks.items(), *((t.encode(), i) for t, i in special.items())]:
            self.bytes_of[i] = b
        if numbered_in_order(name) if fits is None else fits:
            model = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})
            allowed = set(special) if added else set()
            self.encode = lambda text: model.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        else:
            made.encode_special_tokens = not added
            self.encode = lambda text: np.array(made.encode(text, add_special_tokens=False).ids, np.uint32)

    def __call__(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each followed by `end`, and the bounds of the texts."""
        found = [self.encode(t) for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(x) + 1 for x in found])]).astype(np.int64)
        last = np.array([end], np.uint32)
        return np.concatenate([y for x in found for y in (x, last)]).astype("<u4"), bounds


def numbered_in_order(name: str) -> bool:
    """Whether a file's later merges have larger ids, and it cuts texts by the usual byte-level pattern alone."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as f:
        file = json.load(f)
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or file.get("normalizer") or model.get("dropout") or model.get("ignore_merges") or any(
            model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
        return False
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or cut.get("use_regex") is False:
        return False
    ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    return all(x < y for x, y in zip(ids, ids[1:])) and len(set(ids)) == len(ids)


def tokenised(docs: DataFrame, name: str = "byte_bpe_50k.json", length: int = LENGTH, end: int = 0, added: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids) of each document's token ids and an end id, cut only if longer than `length`.

    The remainder comes first, then full pieces. ids are little-endian unsigned 32-bit numbers. Null text is empty: one
    piece, the end id alone. Ids of documents are whole numbers; further columns are left out. `added`: strings of added tokens become their ids. Documents are worked on a few at a time; the longest sets the memory needed.
    """

    fits = numbered_in_order(name)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(name, added, fits)  # made in the task: a remembered one would be sent by name
        for batch in batches:
            for first in range(0, batch.num_rows, 128):
                part = batch.slice(first, 128)
                rows: list[tuple] = []
                found, bounds = tokens([x or "" for x in part.column(1).to_pylist()], end)
                for doc, a, b in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    edges = [a, *range(a + ((b - a) % length or length), b, length), b]
                    rows += [(doc, i, x - a, y - x, found[x:y].tobytes()) for i, (x, y) in enumerate(zip(edges[:-1], edges[1:]))]
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                                                  pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.binary())],
                                                 ["doc_id", "piece", "start", "length", "ids"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary"))


@dataclass
class Plan:
    """Groups of equal sequences. lots[size]: consecutive ranks of that size, each lot as
    (first rank, first sequence, pieces of the size in each sequence, offset of the first)."""

    length: int
    sequences: int = 0
    fixed: int = 0  # of these, closed by dominance
    lots: dict[int, list[tuple[int, int, int, int]]] = field(default_factory=dict)


class _Stock:
    """How many pieces of each size are left, and how many of each have been placed."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left, self.placed = counts.astype(np.int64).copy(), np.zeros(len(counts), np.int64)

    def largest(self, upto: int) -> int:
        found = np.flatnonzero(self.left[:upto + 1]) if upto > 0 else ()
        return int(found[-1]) if len(found) else 0

    def smallest(self, n: int) -> list[int]:
        """The n smallest sizes, equal ones repeated."""
        out: list[int] = []
        for s in np.flatnonzero(self.left):
            out += [int(s)] * int(min(self.left[s], n - len(out)))
            if len(out) == n:
                break
        return out


def _put(plan: Plan, stock: _Stock, sizes: list[int], times: int) -> None:
    """Close `times` sequences that hold `sizes`, largest first."""
    at = 0
    for size in sorted(set(sizes), reverse=True):
        k = sizes.count(size)
        plan.lots.setdefault(size, []).append((int(stock.placed[size]), plan.sequences, k, at))
        stock.placed[size] += k * times
        stock.left[size] -= k * times
        at += k * size
    plan.sequences += times


def _dominating(stock: _Stock, length: int, size: int) -> list[int] | None:
    """What may join one piece of `size` (taken out of stock) so that no other choice can be better; None if unknown.

    Martello and Toth: a set dominates another if its pieces can be split into groups under which the other's fit.
    """
    room = length - size
    best = stock.largest(room)
    if not best:
        return []
    if best == room:
        return [best]
    low = stock.smallest(3)
    if len(low) < 2 or low[0] + low[1] > room:
        return [best]  # only single pieces fit, and this is the largest
    if len(low) == 3 and sum(low) <= room:
        return None  # triples fit as well
    # At most pairs fit: the greatest sum of a pair, and the best partner of the largest single piece.
    sizes = [int(s) for s in np.flatnonzero(stock.left[:room + 1])]
    pairs: list[tuple[int, int]] = []
    for a in sizes:
        j = bisect_left(sizes, min(a, room - a) + 1) - 1
        if j >= 0 and sizes[j] == a and stock.left[a] < 2:
            j -= 1
        if j >= 0:
            pairs.append((a, sizes[j]))
    if best >= max(a + b for a, b in pairs):
        return [best]
    partner = max((b for a, b in pairs if a == best), default=0)
    if partner and all(b <= partner or a + b <= best for a, b in pairs):
        return [best, partner]
    return None


def plan_packing(counts: np.ndarray, length: int = LENGTH) -> Plan:
    """counts[s]: pieces of size s. First every piece, from the largest, whose companions are provably best is fixed;
    the remainder goes by best fit, largest first, whole groups of equal sequences at a time."""
    plan, stock = Plan(length), _Stock(counts)
    for size in range(length, 0, -1):
        while stock.left[size]:
            stock.left[size] -= 1
            joined = _dominating(stock, length, size)
            stock.left[size] += 1
            if joined is None:
                break
            held = [size, *joined]
            # Fewer pieces mean fewer alternatives, so the proof holds until one of the sizes runs out.
            times = min(int(stock.left[s]) // held.count(s) for s in set(held))
            _put(plan, stock, held, times)
    plan.fixed = plan.sequences

    # Best fit by groups: (contents, number of sequences), by the room left in each.
    open_: dict[int, list[tuple[dict[int, int], int]]] = {}
    rooms: list[int] = []

    def opened(room: int, contents: dict[int, int], times: int) -> None:
        if room not in open_:
            at = bisect_left(rooms, room)
            rooms.insert(at, room)
        open_.setdefault(room, []).append((contents, times))

    for size in range(length, 0, -1):
        n = int(stock.left[size])
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                k = length // size
                if n >= k:
                    opened(length - k * size, {size: k}, n // k)
                    n -= n // k * k
                if n:
                    opened(length - n * size, {size: n}, 1)
                n = 0
                continue
            room = rooms[at]
            contents, times = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
            k = min(room // size, n)
            used = min(times, n // k)
            opened(room - k * size, {**contents, size: k}, used)
            if times > used:
                opened(room, contents, times - used)
            n -= used * k
    for groups in open_.values():
        for contents, times in groups:
            _put(plan, stock, [s for s, k in contents.items() for _ in range(k)], times)
    return plan


def place(pieces: DataFrame, length: int = LENGTH, run: int = RUN) -> DataFrame:
    """Adds sequence_id and offset to each piece (doc_id, piece, length, further columns, none of them sequence_id or
    offset); read twice, so settled.

    Ranks among pieces of one length come from runs of a bounded number of pieces, so a length that holds a third of
    all is no one task's. Which of several equal rows gets which place is open, and does not matter.
    """
    sizes = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most `length` rows
    counts = np.zeros(length + 1, np.int64)
    for r in sizes:
        counts[r.length] = r.n
    plan = plan_packing(counts, length)
    runs = {r.length: max(1, -(-r.n // run)) for r in sizes if r.n > run}
    many = F.create_map(*[F.lit(x).cast("long") for pair in runs.items() for x in pair])[F.col("length")] if runs else F.lit(None)
    split = pieces.withColumn("__run", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(many, F.lit(1)).cast("long")))
    ranked = split.withColumn("__rank", F.row_number().over(Window.partitionBy("length", "__run").orderBy("doc_id", "piece")) - 1)
    if runs:
        firsts = split.groupBy("length", "__run").agg(F.count("*").alias("n"))
        firsts = firsts.select("length", "__run", (F.sum("n").over(Window.partitionBy("length").orderBy("__run")) - F.col("n")).alias("__first"))
        ranked = ranked.join(firsts, ["length", "__run"]).withColumn("__rank", F.col("__rank") + F.col("__first"))
    lots = {size: np.array(rows, np.int64).T for size, rows in plan.lots.items()}
    kept = ranked.select(*pieces.columns, F.col("__rank").cast("long").alias("__rank"))
    at = pieces.columns.index("length")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column(at).to_numpy(), batch.column(batch.num_columns - 1).to_numpy()
            sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for s in np.unique(size):
                rows = np.flatnonzero(size == s)
                first, start, each, begin = lots[s]
                lot = np.searchsorted(first, rank[rows], "right") - 1
                nth = rank[rows] - first[lot]
                sequence[rows] = start[lot] + nth // each[lot]
                offset[rows] = begin[lot] + nth % each[lot] * s
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)],
                                             names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    return kept.mapInArrow(put, StructType([*pieces.schema.fields]).add("sequence_id", "long").add("offset", "long"))


def pack(docs: DataFrame, name: str = "byte_bpe_50k.json", length: int = LENGTH, added: bool = False) -> DataFrame:
    """Where each piece of each document goes, with its ids' CRC-32; the ids themselves lie in the settled table."""
    pieces = settle(tokenised(docs, name, length, added=added), "pieces")
    return place(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), length)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token ids of whole sequences, from placed pieces that carry `ids`."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (placed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids")))
