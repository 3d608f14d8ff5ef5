"""Common blocks of lines, deleted from the later of two documents.

Overlapping documents are found as pairs that share a rare line. Each pair is aligned by patience diff, over the lines
that are unique in both; blocks of aligned lines go from the later document. Lines that many documents have make no
pairs. A passage of such lines is found by the hashes of its shortest stretches that are long enough: a stretch goes if
an earlier document has it as well. So every passage of whole lines that an earlier document has goes, however many
documents share it, and text that no single earlier document has stays.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.llm.words import _POWERS, _STEP, as_signed, lines, mix
from digestry.session import settle

MIN_WORDS = 20
RARE = 8            # documents that have a line, at most, for it to make pairs
HOT = 1000          # documents above which a line's or stretch's first document is sent to all tasks
SENT = 100_000      # such lines and stretches that may be sent; if there are more, they are joined like all others


def longest_rise(values: list[int]) -> list[int]:
    """Places of a longest strictly rising subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        at = bisect_left(tops, v)
        back.append(piles[at - 1] if at else -1)
        tops[at:at + 1], piles[at:at + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(mine: list[int], theirs: list[int], n_words: list[int], min_words: int) -> list[int]:
    """Places of aligned lines: (mine, theirs) are the numbers of common lines in both documents, each once, by mine.

    One longest rise is the alignment. Blocks out of its order are aligned after it, if they are long enough on their
    own: lines that follow each other in mine and rise in theirs.
    """
    chosen = set(longest_rise(theirs))
    block: list[int] = []
    for i in [*range(len(mine)), -1]:
        if block and (i < 0 or mine[i] != mine[block[-1]] + 1 or theirs[i] < theirs[block[-1]]):
            if sum(n_words[j] for j in block) >= min_words:
                chosen.update(block)
            block = []
        block.append(i)
    return sorted(chosen)


def runs(mine: list[int], theirs: list[int], n_words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(first, last) places of blocks of aligned lines that are long enough."""
    at = align(mine, theirs, n_words, min_words)
    out, start = [], 0
    for k in range(1, len(at) + 1):
        if k == len(at) or mine[at[k]] != mine[at[k - 1]] + 1 or theirs[at[k]] < theirs[at[k - 1]]:
            if sum(n_words[i] for i in at[start:k]) >= min_words:
                out.append((at[start], at[k - 1]))
            start = k
    return out


_LINE, _STRETCH = 0, 1


def stretches(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, text_key, kind, hash, a, b, place_a, place_b, n_words, total) of docs (doc_id, text_key, text).

    Kind 0: lines that are unique in their text. Kind 1: from each line the shortest stretch of at least `min_words` words
    forward and backward, unless it is a line of kind 0. Every run of that many words is covered by such stretches. a, b: numbers of the first and last line with
    words; place: among all lines, of which there are `total`.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in lines(batch.column(2)):
                k, n = found.last - found.first, len(found.hashes)
                owner = np.repeat(np.arange(k), np.diff(found.bounds))
                number = np.arange(n) - found.bounds[:-1][owner]
                order = np.lexsort((found.hashes, owner))
                same = np.zeros(n + 1, bool)
                same[1:n] = (found.hashes[order][1:] == found.hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
                unique = np.zeros(n, bool)
                unique[order] = ~(same[:-1] | same[1:])
                # Shortest stretches from each line, forward and backward, inside their text.
                total = np.concatenate([[0], np.cumsum(found.n_words)])
                at = np.arange(n)
                ahead = np.searchsorted(total, total[:-1] + min_words) - 1
                behind = np.searchsorted(total, total[1:] - min_words, "right") - 1
                ok_ahead, ok_behind = ahead < found.bounds[1:][owner], behind >= found.bounds[:-1][owner]
                a, b = np.concatenate([at[ok_ahead], behind[ok_behind]]), np.concatenate([ahead[ok_ahead], at[ok_behind]])
                a, b = np.unique(np.stack([a, b]), axis=1) if len(a) else (a, b)
                keep = (a < b) | ~unique[a]
                a, b = a[keep], b[keep]
                up, down = _POWERS.upto(max(n, 1))
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(found.hashes * up[:n], dtype=np.uint64)])
                    joined = np.where(a < b, mix((sums[b + 1] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _STEP), found.hashes[a])
                first = np.concatenate([at[unique], a])
                last = np.concatenate([at[unique], b])
                kind = np.repeat([_LINE, _STRETCH], [int(unique.sum()), len(a)])
                hashes = np.concatenate([found.hashes[unique], joined])
                of, i32 = pa.array(owner[first] + found.first), lambda x: pa.array(x.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(of), batch.column(1).take(of), i32(kind), pa.array(as_signed(hashes)), i32(number[first]), i32(number[last]),
                     i32(found.places[first]), i32(found.places[last]), i32(total[last + 1] - total[first]), i32(found.totals[owner[first]])],
                    ["doc_id", "text_key", "kind", "hash", "a", "b", "place_a", "place_b", "n_words", "total"])

    return docs.where("doc_id is not null").select("doc_id", "text_key", "text").mapInArrow(
        read, "doc_id long, text_key long, kind int, hash long, a int, b int, place_a int, place_b int, n_words int, total int")


def common_blocks(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE, hot: int = HOT, sent: int = SENT) -> DataFrame:
    """(doc_id, text_key, kept, removed): for documents that lose blocks, the ranges (begin, n) of lines that stay, from 1,
    and how many lines go. docs: (doc_id, text_key, text); equal ids are one document.
    """

    def delete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            ids, keys = held.column(0).to_numpy(), held.column(1).to_numpy()
            cut = np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1]))
            if len(cut):
                yield from judged(held.slice(0, cut[-1] + 1))
                held = held.slice(cut[-1] + 1)
        if held is not None and held.num_rows:
            yield from judged(held)

    def judged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Rows of whole documents: stretches that go (theirs is null), and lines met in earlier documents."""
        ids, keys, first, first_key, a, b, theirs, place_a, place_b, n_words, total = (c.to_numpy() for c in table.columns)
        bounds = [0, *(np.flatnonzero((ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])) + 1), len(ids)]
        out: list[tuple] = []
        for x, y in zip(bounds[:-1], bounds[1:]):
            met = np.flatnonzero(~np.isnan(theirs[x:y])) + x
            gone = {(int(a[i]), int(b[i]), int(place_a[i]), int(place_b[i])) for i in range(x, y) if np.isnan(theirs[i])}
            new = np.flatnonzero((first[met][1:] != first[met][:-1]) | (first_key[met][1:] != first_key[met][:-1])) + 1
            for pair in np.split(met, new) if len(met) else []:
                pair = pair[np.unique(a[pair], return_index=True)[1]]  # a repeated row brings its lines again
                gone.update((int(a[pair[i]]), int(a[pair[j]]), int(place_a[pair[i]]), int(place_a[pair[j]]))
                            for i, j in runs(a[pair].tolist(), theirs[pair].astype(np.int64).tolist(), n_words[pair].tolist(), min_words))
            ranges: list[list[int]] = []
            for i, j, p, q in sorted(gone):
                if ranges and i <= ranges[-1][1] + 1:
                    if j > ranges[-1][1]:
                        ranges[-1][1], ranges[-1][3] = j, q
                else:
                    ranges.append([i, j, p, q])
            if ranges:
                edges = [0, *(e for _, _, p, q in ranges for e in (p, q + 1)), int(total[x])]
                kept = [{"begin": p + 1, "n": q - p} for p, q in zip(edges[::2], edges[1::2]) if q > p]
                out.append((int(ids[x]), int(keys[x]), kept, sum(q + 1 - p for _, _, p, q in ranges)))
        if out:
            types = pa.int64(), pa.int64(), pa.list_(pa.struct([("begin", pa.int32()), ("n", pa.int32())])), pa.int32()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["doc_id", "text_key", "kept", "removed"])

    found = settle(stretches(docs, min_words), "stretches")
    shared = settle(found.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("df"))
                    .where("last > first").drop("last"), "shared")
    # What very many documents have goes to all tasks, if it is little, so that no task gets all rows of one line.
    many = shared.where(F.col("df") > hot)
    if many.count() <= sent:
        tagged = found.join(F.broadcast(many), "hash", "left")
        met = tagged.where("df is null").drop("first", "df").join(shared.where(F.col("df") <= hot).hint("merge"), "hash")
        goes = met.unionByName(tagged.where("df is not null"))
    else:
        met = goes = found.join(shared.hint("merge"), "hash")
    gone = goes.where((F.col("first") < F.col("doc_id")) & ((F.col("kind") == _STRETCH) | (F.col("n_words") >= min_words)))
    gone = gone.select("doc_id", "text_key", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("first_key"), "a", "b",
                       F.lit(None).cast("double").alias("theirs"), "place_a", "place_b", "n_words", "total")
    # Lines of few documents: each later document with each earlier one, at most rare * (rare - 1) / 2 pairs a line.
    entry = F.struct("doc_id", "text_key", "a", "place_a", "n_words", "total")
    lists = (met.where((F.col("kind") == _LINE) & (F.col("df") <= rare)).groupBy("hash").agg(F.collect_list(entry).alias("e"))
             .select(F.explode("e").alias("d"), F.col("e").alias("e")))
    pairs = lists.select("d", F.explode(F.filter("e", lambda x: x["doc_id"] < F.col("d.doc_id"))).alias("x"))
    pairs = pairs.select("d.doc_id", "d.text_key", F.col("x.doc_id").alias("first"), F.col("x.text_key").alias("first_key"), "d.a", F.col("d.a").alias("b"),
                         F.col("x.a").cast("double").alias("theirs"), "d.place_a", F.col("d.place_a").alias("place_b"), "d.n_words", "d.total")
    return (gone.unionByName(pairs).repartition("doc_id").sortWithinPartitions("doc_id", "text_key", "first", "first_key", "a")
            .mapInArrow(delete, "doc_id long, text_key long, kept array<struct<begin:int,n:int>>, removed int"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with common blocks of at least `min_words` words taken out of the later documents, and `removed_lines`.

    A block is a run of lines, empty ones between them not counted, that one earlier document (of smaller doc_id) has as
    well: without others between them, or, if at most RARE documents have each of the lines and they are unique in both,
    in the same order. Lines compare by their characters between outer white space; runs meet by 64-bit hashes. What
    stays is unchanged, joined by line breaks; a document that loses all lines has empty text. Null texts stay null,
    rows without a doc_id stay as they are, and rows that repeat a doc_id are one document, which loses nothing to
    itself. A column `removed_lines` is replaced; all others stay.
    """
    keyed = docs.drop("removed_lines").withColumn("__key", F.xxhash64("text"))
    narrow = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__key").alias("text_key"), F.col("text").cast("string").alias("text"))
    blocks = settle(common_blocks(narrow, min_words), "blocks").toDF("__id", "__of", "__kept", "__removed").dropDuplicates(["__id", "__of"])
    # The blocks grow with the table, so they are never broadcast, however few they are.
    joined = keyed.join(blocks.hint("merge"), (F.col("doc_id").cast("long") == F.col("__id")) & (F.col("__key") == F.col("__of")), "left")
    # As the variable of a lambda the text is split once per row, not once per range.
    cut = F.transform(F.array(F.split("text", "\n")), lambda held: F.flatten(F.transform("__kept", lambda r: F.slice(held, r["begin"], r["n"]))))[0]
    return (joined.withColumn("text", F.when(F.col("__kept").isNull(), F.col("text")).otherwise(F.array_join(cut, "\n")))
            .withColumn("removed_lines", F.coalesce("__removed", F.lit(0))).drop("__id", "__of", "__key", "__kept", "__removed"))
