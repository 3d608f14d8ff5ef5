"""Merkle manifest of a dataset: digests, the tree over them, membership proofs.

Rows are leaves. Each run of leaves (such as a language) is a tree of its own; the runs' roots are the leaves of one
more tree, whose root stands for the whole table. The tree is kept as content-addressed records, digest to children, in
segments of at most ARITY ** DEPTH leaves, so one task never holds more than a segment. A proof is found by descent:
from the root, the digits of the leaf's rank choose a child at every node, the children not chosen are collected, and
the path is turned round at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry.session import settle

ARITY = 2
DEPTH = 10  # levels of the tree in one segment

_STEPS = "array<struct<digit:int,siblings:array<string>>>"
_PATH = pa.list_(pa.struct([("digit", pa.int32()), ("siblings", pa.list_(pa.string()))]))
_RECORDS = pa.list_(pa.struct([("digest", pa.binary()), ("children", pa.list_(pa.binary()))]))


def field(value: Column) -> Column:
    """A value's part of a leaf: `-` if null, else its UTF-8 byte count, `:` and itself; integers are decimal."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*values: Column) -> Column:
    """Lowercase hex SHA-256 of the values' parts, in order."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _height(total: int, arity: int) -> int:
    """Levels above `total` nodes until one remains."""
    height = 0
    while total > 1:
        total, height = -(-total // arity), height + 1
    return height


def ranked(rows: DataFrame, run: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """Adds `rank` (from 0) and `total` within rows of equal `run` columns, nulls first. Settled.

    A run of any size is spread over range partitions; only counts per partition and run are brought together.
    """
    by = [F.col(c).asc_nulls_first() for c in (*run, *order)]
    laid = settle(rows.repartitionByRange(*by).sortWithinPartitions(*by)
                  .withColumn("__at", F.monotonically_increasing_id()).withColumn("__part", F.spark_partition_id()), label)
    # A run's rows of one partition lie in a row, from the least `__at` on.
    name = F.concat(*[field(F.col(c)) for c in run]) if run else F.lit("")
    laid = laid.withColumn("__run", name)
    counts = laid.groupBy("__run", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    one = Window.partitionBy("__run")
    counts = counts.select("__run", "__part", "__first", (F.sum("__n").over(one.orderBy("__part")) - F.col("__n")).alias("__before"),
                           F.sum("__n").over(one).alias("total"))
    return (laid.join(counts, ["__run", "__part"]).withColumn("rank", F.col("__at") - F.col("__first") + F.col("__before"))
            .select(F.col("__run").alias("run"), *rows.columns, "rank", "total"))


def grow(nodes: DataFrame, label: str, arity: int = ARITY, depth: int = DEPTH) -> list[DataFrame]:
    """The tree over each run of nodes (run, rank, total, digest), in tiers of settled segments, lowest first.

    A segment (run, rank among the tier's segments, total of them, digest, height, records) is the part of the tree of
    `height` levels below one node. While several nodes remain, each `arity` consecutive ones become one; the last may
    have fewer children, even one.
    """
    width = arity ** depth

    def combine(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        digests, total = table["digest"].to_pylist(), table["total"][0].as_py()
        height, records = min(depth, _height(total, arity)), []
        for _ in range(height):
            above = []
            for i in range(0, len(digests), arity):
                children = digests[i:i + arity]
                above.append(hashlib.sha256("".join(children).encode()).hexdigest())
                records.append({"digest": bytes.fromhex(above[-1]), "children": [bytes.fromhex(c) for c in children]})
            digests = above
        return pa.Table.from_arrays([pa.array([table["run"][0].as_py()], pa.string()), pa.array([table["block"][0].as_py()], pa.int64()),
                                     pa.array([-(-total // width)], pa.int64()), pa.array(digests, pa.string()), pa.array([height], pa.int32()),
                                     pa.array([records], _RECORDS)], ["run", "rank", "total", "digest", "height", "records"])

    tiers: list[DataFrame] = []
    largest = nodes.agg(F.max("total")).first()[0] or 0
    while largest > 1:
        several = nodes.where("total > 1").select("run", F.expr(f"rank div {width}").alias("block"), "rank", "total", "digest")
        tiers.append(settle(several.groupBy("run", "block").applyInArrow(
            combine, "run string, rank long, total long, digest string, height int, records array<struct<digest:binary,children:array<binary>>>"), f"{label}-tier"))
        nodes, largest = tiers[-1].select("run", "rank", "total", "digest"), -(-largest // width)
    return tiers


def roots(nodes: DataFrame, tiers: list[DataFrame]) -> DataFrame:
    """(run, digest, tiers): the root of each run; a lone node is its own."""
    found = nodes.where("total = 1").select("run", "digest", F.lit(0).alias("tiers"))
    for n, tier in enumerate(tiers, 1):
        found = found.unionByName(tier.where("total = 1").select("run", "digest", F.lit(n).alias("tiers")))
    return found


def descend(requests: DataFrame, tiers: list[DataFrame], heads: DataFrame, arity: int = ARITY, depth: int = DEPTH) -> DataFrame:
    """requests (run, rank, total, further columns) with `root`, their run's, and `path`, steps from the leaf to the top.

    heads: (run, tiers, root, path), the last being steps that follow every path of the run. Each tier's segments are
    handed the path from their own root upward, and hand it on to the segments or requests below.
    """
    width = arity ** depth

    def steps(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        segment = right.select(["digest", "height", "root", "above"]).to_pylist()[0]
        held = right["records"].combine_chunks().flatten()
        children_of = dict(zip(held.field("digest").to_pylist(), held.field("children").to_pylist()))
        paths = []
        for rank in left["rank"].to_pylist():
            node, path = bytes.fromhex(segment["digest"]), []
            for level in range(segment["height"] - 1, -1, -1):
                children, digit = children_of[node], rank % width // arity ** level % arity
                path.append({"digit": digit, "siblings": [c.hex() for i, c in enumerate(children) if i != digit]})
                node = children[digit]
            paths.append(path[::-1] + segment["above"])
        kept = left.drop_columns(["block"])
        return kept.append_column("root", pa.array([segment["root"]] * len(paths), pa.string())).append_column("path", pa.array(paths, _PATH))

    below: DataFrame | None = None
    for n in range(len(tiers) - 1, -1, -1):
        tops = heads.where(F.col("tiers") == n + 1).select("run", F.lit(0).cast("long").alias("rank"), "root", "path")
        above = tops if below is None else tops.unionByName(below.select("run", "rank", "root", "path"))
        segments = (tiers[n].join(above.withColumnRenamed("path", "above"), ["run", "rank"])
                    .select("run", F.col("rank").alias("block"), "digest", "height", "records", "root", "above"))
        wanted = (tiers[n - 1].select("run", "rank", "total") if n else requests).where("total > 1")
        wanted = wanted.withColumn("block", F.expr(f"rank div {width}"))
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.drop("block").schema)
        below = (wanted.groupBy("run", "block").cogroup(segments.groupBy("run", "block"))
                 .applyInArrow(steps, f"{types}, root string, path {_STEPS}"))
    lone = requests.where("total = 1").join(heads.where("tiers = 0").select("run", "root", "path"), "run").select(*requests.columns, "root", "path")
    return lone if below is None else lone.unionByName(below)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path lead to."""
    def up(held: Column, step: Column) -> Column:
        before = F.slice(step["siblings"], F.lit(1), step["digit"])
        after = F.slice(step["siblings"], step["digit"] + 1, F.size(step["siblings"]))
        return F.sha2(F.concat(F.array_join(before, ""), held, F.array_join(after, "")), 256)
    return F.aggregate(path, leaf, up)


def path_digest(path: Column) -> Column:
    """Lowercase hex SHA-256 of all siblings on a path, from the leaf upward, left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(path, lambda s: s["siblings"])), ""), 256)


@dataclass
class Manifest:
    """leaves: (run, columns of the rows, leaf, rank, total). tiers and top_tiers: the records, in segments. heads: (run,
    tiers, root, path) of each run. root: None for a table without rows."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top_tiers: list[DataFrame]
    heads: DataFrame
    root: str | None

    def records(self) -> DataFrame:
        """(digest, children), hexadecimal: every inner node of the tree, equal parts of it once."""
        spark = self.leaves.sparkSession
        found = spark.createDataFrame([], "digest string, children array<string>")
        for tier in (*self.tiers, *self.top_tiers):
            node = tier.select(F.explode("records").alias("r"))
            found = found.unionByName(node.select(F.lower(F.hex("r.digest")).alias("digest"), F.transform("r.children", lambda c: F.lower(F.hex(c))).alias("children")))
        return found.dropDuplicates(["digest"])

    def prove(self, requests: DataFrame | None = None) -> DataFrame:
        """Rows of `leaves` (all, or those given) with `root`, that of their run, and `path`, their proof."""
        return descend(self.leaves if requests is None else requests, self.tiers, self.heads)


def manifest(rows: DataFrame, order: str = "doc_id", run: str = "lang") -> Manifest:
    """The tree over rows that carry `leaf`, their digest, by `run`, each ascending by `order`.

    Nulls come first, in both; a null run is one of its own. Rows of equal order are put in the order of their digests;
    equal rows are leaves of their own, any of them in any of their places. Runs are ordered bytewise. Other columns are
    carried, but those called run, rank, total, root, path or block may not be among them unless `run` names them.
    """
    leaves = settle(ranked(rows, [run], [order, "leaf"], "leaves"), "ranked")
    nodes = leaves.select("run", "rank", "total", F.col("leaf").alias("digest"))
    tiers = grow(nodes, "run")
    names = leaves.groupBy("run").agg(F.first(run).alias("name"))
    tops = roots(nodes, tiers).join(names, "run")
    tops = settle(ranked(tops.select(F.col("run").alias("below"), "name", "digest", "tiers"), [], ["name"], "tops"), "top")
    top_nodes = tops.select("run", "rank", "total", "digest")
    top_tiers = grow(top_nodes, "top")
    root = roots(top_nodes, top_tiers).first()
    over = roots(top_nodes, top_tiers).select("run", F.col("tiers"), F.col("digest").alias("root"), F.lit([]).cast(_STEPS).alias("path"))
    proved = descend(tops.withColumnRenamed("tiers", "__tiers"), top_tiers, over)
    heads = settle(proved.select(F.col("below").alias("run"), F.col("__tiers").alias("tiers"), F.col("digest").alias("root"), "path"), "heads")
    return Manifest(leaves, tiers, top_tiers, heads, root["digest"] if root else None)


def verify(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), altered: Sequence[Column] | None = None,
           tampered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of docs.

    The tree is that of the rows as they are. Where `tampered` holds, the leaf handed to the verifier is made from the
    columns `altered` instead of `fields`; its path is the original one. Nulls are values of their own, repeated rows are
    leaves of their own, further columns are left out, and an empty table gives no rows.
    """
    leaf = digest(*[F.col(f) for f in fields])
    shown = F.when(tampered, digest(*altered)).otherwise(leaf) if tampered is not None else leaf
    made = manifest(docs.select("doc_id", "lang", leaf.alias("leaf"), F.nullif(shown, leaf).alias("shown")))
    folded = fold(F.coalesce("shown", "leaf"), F.col("path"))
    out = made.prove().select("doc_id", "leaf", F.col("root").alias("subroot"), F.lit(made.root).cast("string").alias("root"),
                              path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
