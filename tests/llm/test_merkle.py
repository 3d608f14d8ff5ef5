import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from digestry.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """(root, path of each node as (own place among its siblings' parent's children, siblings))."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p // 2 * 2:p // 2 * 2 + 2]
            paths[i].append((p % 2, [x for j, x in enumerate(run) if j != p % 2]))
            at[i] = p // 2
        level = [H(*level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0], paths


def plain(rows):
    """What verify() gives, row by row."""
    leaf = lambda r, more=0: H(field(r[0]), field(r[3]), field(r[2]), field(r[4] if r[4] is None else r[4] + more), field(r[1]))
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    runs = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in langs}
    trees = {g: climb([leaf(r) for r in runs[g]]) for g in langs}
    root, above = climb([trees[g][0] for g in langs])
    out = []
    for g, over in zip(langs, above):
        for r, path in zip(runs[g], trees[g][1]):
            steps = path + over
            held = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for digit, others in steps:
                held = H(*others[:digit], held, *others[digit:])
            out.append((r[0], leaf(r), trees[g][0], root, H(*[x for _, o in steps for x in o]), held, held == root))
    return sorted(out, key=repr)


def found(docs):
    altered = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")]
    got = merkle.verify(docs, altered=altered, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0)
    return sorted((tuple(r) for r in got.collect()), key=repr)


def made(n, seed=5):
    rng = random.Random(seed)
    rows = [(i * rng.choice((1, 1, 7)) + i, rng.choice(("a", "é" * 9, "", None)), rng.choice(("en", "en", "en", "de", "ça", None)),
             rng.choice(("s", None)), rng.choice((None, i))) for i in range(n)]
    return rows + [(None, "no id", "en", None, None)] + [(5, "twice", "en", "s", 5)] * 3


@pytest.mark.parametrize("n", [0, 1, 6, 90])
def test_against_plain(spark, n):
    rows = made(n) + [(10**12, "x" * 300_000, "long", None, 3)]
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(7)) == plain(rows)


def test_several_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DEPTH", 2)
    rows = made(150, 8)
    for f in (merkle.grow, merkle.descend):
        monkeypatch.setattr(f, "__defaults__", (2, 2))
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_one_row_and_one_language(spark):
    for rows in ([(1, "t", "en", "s", 1)], [(1, "t", None, "s", 1), (2, "u", None, "s", 1), (3, "v", None, "s", 1)]):
        assert found(spark.createDataFrame(rows, SCHEMA)) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    assert found(spark.createDataFrame([], SCHEMA)) == []
    rows = made(12)
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("run", "rank", "total", "root", "path", "block", "leaf", "shown", "digest"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(docs) == plain(rows)


def test_wider_nodes_and_records(spark):
    """Any arity; every record's digest is that of its children, and all nodes below the root are there."""
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)]
    nodes = spark.createDataFrame([("r", i, 40, x) for i, x in enumerate(leaves)], "run string, rank long, total long, digest string")
    tiers = merkle.grow(nodes, "wide", arity=3, depth=2)
    level = leaves
    while len(level) > 1:
        level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
    top = merkle.roots(nodes, tiers)
    assert top.first()["digest"] == level[0]
    proved = merkle.descend(nodes, tiers, top.select("run", "tiers", F.col("digest").alias("root"), F.lit([]).cast(merkle._STEPS).alias("path")), arity=3, depth=2)
    assert {r[0] for r in proved.select(merkle.fold(F.col("digest"), F.col("path"))).collect()} == {level[0]}
    docs = spark.createDataFrame(made(20), SCHEMA)
    book = merkle.manifest(docs.select("doc_id", "lang", F.sha2("text", 256).alias("leaf")).na.fill("0" * 64, ["leaf"]))
    records = {r.digest: r.children for r in book.records().collect()}
    assert all(H(*c) == d for d, c in records.items()) and book.root in records
    some = book.prove(book.leaves.where("doc_id < 9"))
    assert 0 < some.count() < 20 and some.where(merkle.fold(F.col("leaf"), F.col("path")) != book.root).count() == 0
