"""Near-duplicate documents by min-max hashing.

Each permutation gives two signature values, the least and the greatest hash of the document's shingle set, so half
the hash evaluations fill the same bands. Bands propose pairs, the full shingle sets decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from digestry.llm.graph import components
from digestry.llm.words import as_signed, mix, shingle_sets, words
from digestry.session import settle

SHINGLE = 5
FEW = 32  # members up to which the pairs of a bucket become rows
BLOCK = 250_000  # shingles of the members of one block
BAND_ROWS = 5
MISSED = 1e-5  # greatest probability that a pair at the limit shares no band

_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature binary"
_CHECKED = "u long, v long, shared long, total long"


def permutations_for(percent: int, band_rows: int = BAND_ROWS) -> int:
    """As many as give enough bands to find a pair at the limit: 50 (20 bands of 5) for 85 per cent, 73 (29) for 80."""
    bands = 1 if percent >= 100 else math.ceil(math.log(MISSED) / math.log1p(-((percent / 100) ** band_rows)))
    return -(-bands * band_rows // 2)


def signatures(docs: DataFrame, n: int = SHINGLE, permutations: int = 50, band_rows: int = BAND_ROWS) -> DataFrame:
    """Size, 128-bit fingerprint, band hashes and signature of each document's shingle set, from one read of the text."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = mix(np.arange(5000, 5000 + permutations, dtype=np.uint64)) | np.uint64(1)
        bands = 2 * permutations // band_rows
        for batch in batches:
            for found in words(batch.column(1)):
                sets, bounds = shingle_sets(found, n)
                sizes = np.diff(bounds)
                full, k = np.flatnonzero(sizes), found.last - found.first
                values = np.zeros((k, 2 * permutations), np.uint64)
                prints = np.zeros((k, 2), np.uint64)
                if len(full):
                    at = bounds[:-1][full]
                    with np.errstate(over="ignore"):
                        for p in range(permutations):
                            moved = sets * multipliers[p]
                            values[full, 2 * p] = np.minimum.reduceat(moved, at)
                            values[full, 2 * p + 1] = np.maximum.reduceat(moved, at)
                        prints[full, 0] = np.add.reduceat(sets, at)
                        prints[full, 1] = np.add.reduceat(mix(sets), at)
                with np.errstate(over="ignore"):
                    scale = mix(np.arange(7000, 7000 + band_rows, dtype=np.uint64)) | np.uint64(1)
                    keys = mix((values[:, :bands * band_rows].reshape(k, bands, band_rows) * scale).sum(2) + mix(np.arange(bands, dtype=np.uint64)))
                short = (values >> np.uint64(48)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(found.first, k), pa.array(sizes, pa.int64()),
                    pa.array(as_signed(prints[:, 0].copy())), pa.array(as_signed(prints[:, 1].copy())),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, k * bands + 1, bands), pa.int32()), pa.array(as_signed(keys.ravel()))),
                    pa.array([row.tobytes() for row in short], pa.binary())],
                    ["doc_id", "n_shingles", "set_a", "set_b", "bands", "signature"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(sign, _SIGNED)


def _alike(pairs: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Leave out pairs whose signatures say that they are hopeless: more than seven standard errors below the limit."""
    s, rows = percent / 100, 2 * permutations_for(percent)
    least = s - 7 * (s * (1 - s) / rows) ** 0.5

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((a == b).mean(1) >= least))

    one = signed.select(F.col("node").alias("u"), F.col("signature").alias("su"))
    two = signed.select(F.col("node").alias("v"), F.col("signature").alias("sv"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "su", "sv").mapInArrow(judge, "u long, v long")


def _confirmed(pairs: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """Size of intersection and union of the full sets of each pair (u, v)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[bytes, np.ndarray]] = {}

        def sets_of(column: pa.Array) -> list[np.ndarray]:
            out = []
            for found in words(column):
                sets, bounds = shingle_sets(found, n)
                out += [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                runs = part.column(1).to_numpy()
                new = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))  # rows come by v, which repeats
                heads = sets_of(part.column(3).take(pa.array(new)))
                which = np.cumsum(np.isin(np.arange(len(runs)), new)) - 1
                mine = sets_of(part.column(2))
                shared = [len(np.intersect1d(a, heads[k], assume_unique=True)) for a, k in zip(mine, which)]
                total = [len(a) + len(heads[k]) - s for a, k, s in zip(mine, which, shared)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared, pa.int64()), pa.array(total, pa.int64())],
                                                 ["u", "v", "shared", "total"])

    needed = pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct()
    texts = settle(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi"), "texts")
    return (pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("tu")), "u")
            .join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("tv")), "v")
            .select("u", "v", "tu", "tv").mapInArrow(count, _CHECKED))


def _in_blocks(crowded: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (u, v) that join different components, from buckets of many members (bucket, u, c, weight).

    The members of a bucket are dealt into blocks of a bounded number of shingles, and each pair of blocks is one
    group. An inverted index of one block counts the exact intersections with each member of the other. A pair is
    looked at in the first band that it shares; of its links a group gives only those that join what is still apart.
    """

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in words(batch.column(1)):
                sets, bounds = shingle_sets(found, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(found.first, found.last - found.first),
                                                  pa.array([sets[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())], ["u", "members"])

    def link(group: pa.Table) -> pa.Table:
        u, c, side = (group.column(k).to_numpy() for k in ("u", "c", "side"))
        bucket, low, high = (group.column(k)[0].as_py() for k in ("bucket", "low", "high"))
        sets = [np.frombuffer(x, np.uint64) for x in group.column("members").to_pylist()]
        sizes = np.array([len(x) for x in sets])
        bands = np.array(group.column("bands").to_pylist(), np.int64)
        band = int(np.flatnonzero((bands == bucket).all(0))[0])
        left, right = np.flatnonzero(side == low), np.flatnonzero(side == high)
        if not len(left) or not len(right):  # a block that got no member
            return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
        owner = np.repeat(np.arange(len(right)), sizes[right])
        held = np.concatenate([sets[i] for i in right])
        order = np.argsort(held, kind="stable")
        held, owner = held[order], owner[order]
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        out: list[tuple[int, int]] = []
        for i in left:
            mine = (c[right] != c[i]) & (100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i]))
            if low == high:
                mine &= u[right] < u[i]
            if band and mine.any():
                mine &= ~(bands[right, :band] == bands[i, :band]).any(1)
            if not mine.any():
                continue
            at, to = np.searchsorted(held, sets[i], "left"), np.searchsorted(held, sets[i], "right")
            runs = to - at
            where = np.repeat(at - np.concatenate([[0], np.cumsum(runs)[:-1]]), runs) + np.arange(runs.sum())
            shared = np.bincount(owner[where], minlength=len(right))
            for j in np.flatnonzero(mine & (100 * shared >= percent * (sizes[i] + sizes[right] - shared))):
                a, b = top(int(c[i])), top(int(c[right[j]]))
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((int(u[i]), int(u[right[j]])))
        return pa.table({"u": pa.array([x for x, _ in out], pa.int64()), "v": pa.array([y for _, y in out], pa.int64())})

    needed = crowded.select(F.col("u").alias("doc_id")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(needed, "doc_id", "left_semi")
    sets = settle(texts.mapInArrow(shingles, "u long, members binary").join(
        classes.select(F.col("node").alias("u"), "bands", "n_shingles").dropDuplicates(["u"]), "u").where("octet_length(members) = 8 * n_shingles"), "block-sets")
    blocks = F.ceil(F.col("weight") / BLOCK).cast("int")
    dealt = (crowded.select("bucket", "u", "c", "weight").withColumn("side", F.pmod(F.xxhash64("u"), blocks).cast("int"))
             .select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
             .select("bucket", "u", "c", "side", F.least("side", "with").alias("low"), F.greatest("side", "with").alias("high")))
    return (dealt.join(sets.select("u", "bands", "members"), "u").groupBy("bucket", "low", "high").applyInArrow(link, "u long, v long"))


def near_duplicates(docs: DataFrame, percent: int = 85, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text).

    Two documents are linked if 100 * |intersection| >= percent * |union| of their n-word shingle sets; component_id
    is the smallest doc_id reachable. Equal sets are one class, known by its smallest id and linked without a pair.
    Within a bucket every class is held against the bucket's first one. Members of a bucket that are still in
    different components are then held against each other: as pairs in buckets of a few, else in blocks that give
    links between components only. No partner is dropped by count.

    A document without words has an empty set and is linked with nothing. A null doc_id is linked with nothing and has
    no component, yet is kept. Rows that repeat a doc_id are judged each by its own text. Ids are whole numbers.
    """
    signed = settle(signatures(docs, n, permutations_for(percent)), "signatures")
    sets = (signed.where("n_shingles > 0 and doc_id is not null").groupBy("set_a", "set_b", "n_shingles")
            .agg(F.min("doc_id").alias("node")))
    sets = settle(sets, "sets")
    classes = (signed.join(sets, ["set_a", "set_b", "n_shingles"]).where("doc_id = node")
               .dropDuplicates(["node", "set_a", "set_b"]))
    classes = settle(classes.select("node", "n_shingles", "bands", "signature"), "classes")

    members = classes.select(F.explode("bands").alias("bucket"), "node", "n_shingles")
    firsts = members.groupBy("bucket").agg(F.min("node").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = settle(members.join(firsts, "bucket"), "buckets")

    fits = f"100 * least({{0}}, {{1}}) >= {percent} * greatest({{0}}, {{1}})"
    heads = _confirmed(_alike(members.where("node <> v").select(F.col("node").alias("u"), "v").distinct(), classes, percent), docs, n)
    heads = settle(heads, "checked")
    linked = f"100 * shared >= {percent} * total"
    first_links = heads.where(linked).select("u", "v")
    labels = settle(components(first_links), "labels")

    known = (members.drop("v").join(labels, "node", "left")
             .select("bucket", F.col("node").alias("u"), "n_shingles", F.coalesce("component", "node").alias("c")))
    known = settle(known, "known")
    open_ = known.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("weight"), F.min("c").alias("a"), F.max("c").alias("b"))
    open_ = known.join(open_.where("a <> b").drop("a", "b"), "bucket")
    few = open_.where(f"n <= {FEW}")
    other = few.select("bucket", F.col("u").alias("v"), F.col("n_shingles").alias("m"), F.col("c").alias("c2"))
    rest = (few.join(other, "bucket").where("u > v and c <> c2").where(fits.format("n_shingles", "m"))
            .select("u", "v").distinct().join(heads.select("u", "v"), ["u", "v"], "left_anti"))
    rest = settle(_alike(rest, classes, percent), "rest")
    more = _confirmed(rest, docs, n).where(linked).select("u", "v")
    more = settle(more.unionAll(_in_blocks(settle(open_.where(f"n > {FEW}"), "crowded"), classes, docs, percent, n)), "more")
    if not more.isEmpty():
        labels = components(first_links.unionAll(more))

    of_set = sets.join(labels, "node", "left").select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component_id"))
    return (signed.join(of_set, ["set_a", "set_b", "n_shingles"], "left")
            .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
