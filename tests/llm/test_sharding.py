import hashlib
import zlib

import pytest

from digestry.llm import sharding

SCHEMA = "doc_id long, text string, slot int, key string"


def key(doc, text):
    of = lambda s, n: int(hashlib.md5(s.encode()).hexdigest()[:n], 16)
    return of(text or "", 8) * (1 << 28) + of("" if doc is None else str(doc), 7)


def plain(rows, shards):
    """Shard of each row by the bytes below its key."""
    size = lambda t: len((t or "").encode()) + 16
    total, out, below = sum(size(t) for _, t in rows), {}, 0
    for k in sorted({key(*r) for r in rows}):
        out[k] = below * shards // total
        below += sum(size(t) for d, t in rows if key(d, t) == k)
    return out


ROWS = [*((i, "copy of one text") for i in range(400)), *((i, f"text {i} " + "é" * (i % 40)) for i in range(400, 900)), (1000, None), (1001, ""), (None, "x"),
        (3007, "twice"), (3007, "twice"), (2000, "long " * 3000)]


@pytest.mark.parametrize("shards, run", [(1, 10 ** 6), (7, 10 ** 6), (40, 11)])
def test_against_bytes_below(spark, shards, run):
    docs = spark.createDataFrame([(*r, 1, "x") for r in ROWS], SCHEMA)
    got = sharding.shard(docs, shards, run=run).collect()
    assert len(got) == len(ROWS)
    expected = plain(ROWS, shards)
    texts = {r[0]: r[1] for r in ROWS}
    for r in got:
        assert r.shard == expected[key(r.doc_id, texts[r.doc_id])]
        assert r.size == len((texts[r.doc_id] or "").encode()) + 16 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
    for s in range(shards):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_tolerance_and_balance(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 30)) for i in range(3000)], "doc_id long, text string")
    for tolerance in (0.0, 0.2):
        got = sharding.shard(docs, 10, tolerance=tolerance).groupBy("shard").sum("size").collect()
        sizes = [r[1] for r in got]
        assert len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * (46 + tolerance * sum(sizes) / 10)


def test_empty_table_and_carried_columns(spark):
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 5).collect() == []
    got = sharding.shard(spark.createDataFrame([(1, "a", 9, "k")], SCHEMA), 5, carry=("text", "key", "slot"))
    assert got.columns == ["doc_id", "size", "text_crc32", "text", "shard", "slot"] and got.first().text == "a"
