"""Near-duplicate items by the direction of their embeddings.

Walking items in the order of their ids, an item is dropped if its vector's cosine with that of one *kept* before it is
large enough: the rule of `titles`, with another measure. Candidates come from locality-sensitive hashing: the signs of
products with random directions, in as many tables as the wanted recall takes. Where two items meet in a bucket, sketches
of more such signs rule out nearly all that are not close before anything is shuffled; every link is confirmed by the
exact cosine. Two things keep groups of near-copies from being paired up:

* Equal vectors collapse to the first of them and share its fate.
* Where sketches show too many links, the first items are resolved and everything close to a kept one is dropped at once;
  then the next, four times larger, stretch follows. A group disappears with its first member.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.operators.titles import MOST_PARTS, _resolve, _shuffled, _together
from digestry.session import settle
from digestry.settings import Settings

RECALL = 0.999      # of links at the limit; closer ones are found more often
MOST_TABLES = 40    # so the number of tables, and with it what is shuffled for an item, stops growing at some 10,000 items
SKETCH = 4          # longs of further signs
SPREAD = 6          # standard errors by which the signs of a link may differ more than expected: one link in 10**9 is missed
IN_BUCKET = 4       # items wanted in a bucket
LINKS = 32          # expected links of an item beyond which stretches are resolved one after the other
CROWD = 4096        # items of a bucket that one task joins; larger buckets are split
SEED = 7

_KEYS = ["_all"]


def tables_for(n: int, at_least: float, recall: float = RECALL) -> tuple[int, int]:
    """(tables, bits of each): as many bits as n items are worth, and as MOST_TABLES tables allow for the recall."""
    same = 1 - math.acos(min(max(at_least, -1.0), 1.0)) / math.pi
    need = lambda bits: math.ceil(math.log(1 - recall) / math.log1p(-min(same ** bits, 1 - 1e-12)))
    bits = min(max(1, math.ceil(math.log2(max(n, 2) / IN_BUCKET))), 40)
    while bits > 1 and need(bits) > MOST_TABLES:
        bits -= 1
    return need(bits), bits


def _hashed(nodes: DataFrame, size: int, tables: int, bits: int, seed: int) -> DataFrame:
    """(_rank, unit, codes, s0, s1, ...): vectors of length one, their bucket in each table, and their sketch."""
    rng = np.random.default_rng(seed)
    directions, more = rng.standard_normal((size, tables * bits)), rng.standard_normal((size, SKETCH * 64))
    powers, places = 1 << np.arange(bits, dtype=np.int64), np.arange(tables, dtype=np.int64) << bits

    def lists(values: np.ndarray) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.reshape(-1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)
            unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
            codes = (unit @ directions > 0).reshape(-1, tables, bits) @ powers + places
            signs = np.packbits(unit @ more > 0, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists(unit), lists(codes), *map(pa.array, signs.T)], ["_rank", "unit", "codes", *names])

    names = _sketch()
    return nodes.mapInArrow(run, "_rank long, unit array<double>, codes array<long>" + "".join(f", {c} long" for c in names))


def _sketch(side: str = "") -> list[str]:
    return [f"{side}s{i}" for i in range(SKETCH)]


def most_apart(at_least: float) -> int:
    """Signs of a sketch in which two vectors at the limit may differ."""
    apart, n = math.acos(min(max(at_least, -1.0), 1.0)) / math.pi, SKETCH * 64
    return math.ceil(n * apart + SPREAD * math.sqrt(n * apart * (1 - apart)))


def cosine(a: Column, b: Column) -> Column:
    """Of vectors of length one."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _buckets(nodes: DataFrame, side: str) -> DataFrame:
    return nodes.select(F.col("_rank").alias(side), *(F.col(c).alias(f"{side}{c}") for c in _sketch()), F.explode("codes").alias("_code"))


def _close(left: DataFrame, right: DataFrame, at_least: float, within: Column | None = None, few: bool = False) -> DataFrame:
    """(_l, _r, cosine): links between nodes of two tables that share a bucket. Crowded buckets of the left are split.

    Only pairs whose sketches are close leave the task in which they meet. With `few` nodes on the right, known to be
    bounded, these go to the left ones.
    """
    a, b = _buckets(left, "_l"), _buckets(right, "_r")
    near = reduce(add, (F.bit_count(F.col(x).bitwiseXOR(F.col(y))) for x, y in zip(_sketch("_l"), _sketch("_r")))) <= most_apart(at_least)
    met = (a.join(F.broadcast(b), "_code") if few else _met(a, b)).where(near)
    pairs = (met if within is None else met.where(within)).select("_l", "_r").distinct()
    ends = _shuffled(pairs, left.select(F.col("_rank").alias("_l"), F.col("unit").alias("_lu")), ["_l"])
    ends = _shuffled(ends, right.select(F.col("_rank").alias("_r"), F.col("unit").alias("_ru")), ["_r"])
    return ends.select("_l", "_r", cosine(F.col("_lu"), F.col("_ru")).alias("cosine")).where(F.col("cosine") >= at_least)


def _met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables of buckets that meet in one; crowded ones are split by the left side."""
    sizes = a.groupBy("_code").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWD)
    parts = settle(sizes.select("_code", F.ceil(F.col("_n") / CROWD).alias("_parts")), "vector-crowds")
    if parts.isEmpty():
        return _shuffled(a, b, ["_code"])
    a = a.join(parts, "_code", "left").withColumn("_part", F.pmod(F.col("_l"), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    b = b.join(parts, "_code", "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))).drop("_parts")
    return _shuffled(a, b, ["_code", "_part"])


def _expected(nodes: DataFrame, at_least: float) -> float:
    """Links, from how many halves of the longs of sketches are equal: estimated as if all were at the limit, so not too few."""
    same = (1 - math.acos(min(max(at_least, -1.0), 1.0)) / math.pi) ** 32
    halves = [F.struct(F.lit(2 * i + k).alias("at"), (F.shiftright(c, 32) if k else F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))).alias("is")) for i, c in enumerate(_sketch()) for k in (0, 1)]
    sizes = nodes.select(F.explode(F.array(*halves)).alias("_half")).groupBy("_half").agg(F.count("*").cast("double").alias("n"))
    return (sizes.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0.0) / (len(halves) * same)


def _first(nodes: DataFrame, count: int, size: int) -> Column:
    """Whether a node is among about `size` first ones of `count`; one at least is."""
    share = F.percentile_approx("_rank", min(size / count, 1.0), min(max(10_000, 4 * count // size), 1_000_000))
    return F.col("_rank") <= nodes.agg(share).first()[0]


def _nodes(rows: DataFrame, at_least: float, recall: float, seed: int) -> tuple[DataFrame, DataFrame] | None:
    """(rows with `_tie`, the first id of their vector; hashed nodes, one a vector, with that id as rank); None if no row
    has a direction."""
    size = rows.where("_usable").agg(F.max(F.size("_vector"))).first()[0]
    if not size:
        return None
    rows = settle(rows.withColumn("_usable", F.col("_usable") & (F.size("_vector") == size)), "vectors")
    firsts = settle(rows.where("_usable").groupBy("_vector").agg(F.min("_id").alias("_tie")), "vector-firsts")
    tables, bits = tables_for(firsts.count(), at_least, recall)
    nodes = settle(_hashed(firsts.select(F.col("_tie").alias("_rank"), "_vector"), size, tables, bits, seed), "vector-codes")
    named = _shuffled(rows, firsts, ["_vector"], "left")
    return settle(named.select("_id", F.when(F.col("_usable"), F.col("_tie")).alias("_tie")), "vector-rows"), nodes


def _usable(rows: DataFrame, id_: str, vector: str) -> DataFrame:
    values = F.col(vector).cast("array<double>")
    found = rows.where(F.col(id_).isNotNull()).select(F.col(id_).cast("long").alias("_id"), values.alias("_vector"))
    bad = F.exists("_vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return found.withColumn("_usable", F.coalesce(~bad & F.exists("_vector", lambda x: x != 0), F.lit(False)))


def vector_links(rows: DataFrame, s: Settings, at_least: float = 0.9, id_: str = "vec_id", vector: str = "embedding",
                 recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(earlier, later, cosine) of all close pairs of distinct vectors, each under its first id. For tables without large
    groups of near-copies; `drop_close` never lists such pairs."""
    made = _nodes(_usable(rows, id_, vector), at_least, recall, seed)
    if made is None:
        return rows.sparkSession.createDataFrame([], "earlier long, later long, cosine double")
    nodes = made[1]
    return _close(nodes, nodes, at_least, F.col("_l") < F.col("_r")).select(F.col("_l").alias("earlier"), F.col("_r").alias("later"), "cosine")


def drop_close(rows: DataFrame, s: Settings, at_least: float = 0.9, id_: str = "vec_id", vector: str = "embedding",
               recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """(id, representative, kept) of every row that has an id.

    The representative of a kept row is itself; of a dropped one, the first kept row it is close to (cosine of at least
    `at_least`, which is above 0). Vectors without a direction (null, all zero, with a null or a value that is no
    number) and those shorter than the longest are close to nothing. Links are those that hashing finds, see RECALL.
    """
    usable = _usable(rows, id_, vector)
    made = _nodes(usable, at_least, recall, seed)
    if made is None:
        return usable.select(F.col("_id").alias(id_), F.col("_id").alias("representative"), F.lit(True).alias("kept"))
    named, rest = made
    found, size = [], s.fold_rows
    few = lambda part: _expected(part, at_least) <= part.count() * min(s.pairs_per_title, LINKS)
    while count := rest.count():
        whole = count <= s.fold_rows or few(rest)
        stretch = rest
        if not whole:
            first = _first(rest, count, size)
            if size > s.fold_rows and not few(rest.where(first)):
                size = s.fold_rows
                first = _first(rest, count, size)
            stretch = rest.where(first)
        pairs = _close(stretch, stretch, at_least, F.col("_l") < F.col("_r"))
        inside = settle(_resolve(pairs.select(F.lit(0).alias("_all"), F.col("_r").alias("_later"), F.col("_l").alias("_earlier")), s, _KEYS)
                        .select("_rank", "_of"), "vector-stretch")
        found.append(inside)
        if whole:
            break
        kept = settle(_shuffled(stretch, inside, ["_rank"], "left_anti"), "vector-kept")
        rest = rest.where(~first)
        hit = settle(_close(rest, kept, at_least, few=size <= s.fold_rows).groupBy(F.col("_l").alias("_rank")).agg(F.min("_r").alias("_of")), "vector-hits")
        found.append(hit)
        rest = settle(_shuffled(rest, hit, ["_rank"], "left_anti"), "vector-rest")
        size *= 4
        if len(found) > MOST_PARTS:
            found = [settle(_together(found), "vector-found")]
    by_tie = _together(found).select(F.col("_rank").alias("_tie"), "_of")
    whose = F.coalesce("_of", "_tie", "_id")
    return (_shuffled(named, by_tie, ["_tie"], "left").select(F.col("_id").alias(id_), whose.alias("representative"), (whose == F.col("_id")).alias("kept")))
