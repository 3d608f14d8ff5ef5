"""Shards of nearly equal bytes by histogram sort.

Rows have a key that spreads evenly and keeps equal texts side by side. Exact byte counts below candidate key
boundaries, summed over all partitions, narrow each splitter down round by round; then rows move once. No row is
sampled, and only counts come to the driver: at most `FIRST` in the first round and `shards * FINER` in each later one.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.session import settle

OVERHEAD = 16
KEY_BITS = 60
FIRST_BITS, FINER_BITS = 12, 8
RUN = 1_000_000  # rows one task numbers


def _hex(value: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(value), 1, digits), 16, 10).cast("long")


def row_key(text: Column, doc_id: Column) -> Column:
    """60 bits: 32 of the text's digest, so that copies lie together, then 28 of the id's, so that they can be split."""
    return _hex(text, 8) * (1 << 28) + _hex(F.coalesce(doc_id.cast("string"), F.lit("")), 7)


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.0) -> list[int]:
    """The shards - 1 boundaries between shards of rows (key, size): a row's shard is the number of boundaries <= its key.

    Boundary k is the least key below which lie at least k / shards of all bytes; with a tolerance, a candidate that
    misses that share by at most this part of one shard's bytes is taken as it is. Each round counts bytes exactly.
    A key never splits, so rows that equal in text and id stay in one shard.
    """
    step = FIRST_BITS
    shift = KEY_BITS - step
    rounds = keys.groupBy(F.shiftright("key", shift).alias("cell"))
    counted = sorted((r.cell, r.size, r.low, r.high) for r in
                     rounds.agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
    total = sum(size for _, size, _, _ in counted)
    # A splitter's goal in bytes, times `shards` to stay in whole numbers; open ones look into one cell.
    found: dict[int, int] = {}
    goals = {k: k * total for k in range(1, shards)}
    below = 0
    cells: dict[int, int] = {}  # bytes before a cell

    def advance(rows: list[tuple[int, int, int, int]], start: int, own: dict[int, int], bits: int) -> dict[int, list[int]]:
        """Settle the splitters that end in these cells, and tell which cells the others are in."""
        open_: dict[int, list[int]] = {}
        at, k = start, 0
        order = sorted(own, key=own.get)
        for cell, size, low, high in rows:
            while k < len(order) and own[order[k]] <= (at + size) * shards:
                goal = own[order[k]]
                if goal <= at * shards:
                    found[order[k]] = low
                elif (at + size) * shards - goal <= tolerance * total:
                    found[order[k]] = high + 1
                elif goal - at * shards <= tolerance * total:
                    found[order[k]] = low
                elif low == high:
                    found[order[k]] = high + 1
                else:
                    open_.setdefault(cell, []).append(order[k])
                    cells[cell] = at
                k += 1
            at += size
        for rest in order[k:]:
            found[rest] = 1 << KEY_BITS
        return open_

    pending = advance(counted, below, goals, step)
    while pending:
        finer = min(FINER_BITS, shift)
        inside = keys.where(F.shiftright("key", shift).isin(list(pending)))
        parent, shift = shift, shift - finer
        counted = sorted((r.parent, r.cell, r.size, r.low, r.high) for r in
                         inside.groupBy(F.shiftright("key", parent).alias("parent"), F.shiftright("key", shift).alias("cell"))
                         .agg(F.sum("size").alias("size"), F.min("key").alias("low"), F.max("key").alias("high")).collect())
        before, cells, now = cells, {}, {}
        for cell, waiting in pending.items():
            now |= advance([r[1:] for r in counted if r[0] == cell], before[cell], {k: goals[k] for k in waiting}, shift)
        pending = now
    return [found[k] for k in range(1, shards)]


def shard_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted boundaries are at or below the key, by halving."""
    if not bounds:
        return F.lit(0)

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key >= bounds[middle], half(middle + 1, high)).otherwise(half(low, middle))

    return half(0, len(bounds))


def shard(docs: DataFrame, shards: int = 40, carry: tuple[str, ...] = (), tolerance: float = 0.0, run: int = RUN) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) and the columns in `carry` of each row of docs (doc_id, text).

    size: the text's bytes plus 16; a null text has none, and a null doc_id is a key of its own. Slots count from 0
    without gaps within a shard. A shard has its share of the bytes up to one row (or the tolerance), however
    many rows share one text; equal rows stay together. Texts are read once and do not move unless carried.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
                       row_key(text, F.col("doc_id")).alias("key"), *(c for c in carry if c not in ("doc_id", "size", "text_crc32", "key", "shard", "slot")))
    rows = settle(rows, "shard-keys")
    bounds = splitters(rows.select("key", "size"), shards, tolerance)
    placed = rows.withColumn("shard", shard_of(F.col("key"), bounds).cast("int"))
    most = {r.shard: -(-r.n // run) for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    runs = max(most.values(), default=1)
    # Long shards are numbered in runs of bounded size; a run's first slot is the number of rows in the runs before it.
    placed = placed.withColumn("__run", F.pmod(F.xxhash64("key"), F.lit(runs)).cast("int"))
    order = Window.partitionBy("shard", "__run").orderBy("key", "doc_id", "size")
    slotted = placed.withColumn("slot", (F.row_number().over(order) - 1).cast("long"))
    if runs > 1:
        firsts = placed.groupBy("shard", "__run").agg(F.count("*").alias("n"))
        firsts = firsts.select("shard", "__run", (F.sum("n").over(Window.partitionBy("shard").orderBy("__run")) - F.col("n")).alias("first"))
        slotted = slotted.join(firsts, ["shard", "__run"]).withColumn("slot", F.col("slot") + F.col("first"))
    return slotted.select(*(c for c in rows.columns if c != "key"), "shard", "slot")
