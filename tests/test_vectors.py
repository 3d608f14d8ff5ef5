"""Near-duplicates by embedding against all pairs."""

import numpy as np
import pytest

from digestry import Settings
from digestry.operators import vectors

S = Settings(fold_rows=32)
LAYOUT = "vec_id bigint, embedding array<float>"


def greedy(rows, at_least):
    """{id: first kept id it is close to}, walking over all ids in order and comparing with every kept one."""
    usable = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    size = max(map(len, usable.values()), default=0)
    kept, out = [], {}
    for i in sorted(i for i, _ in rows):
        v = usable.get(i)
        if v is None or len(v) != size:
            out[i] = i
            continue
        v = v / np.linalg.norm(v)
        out[i] = next((k for k, u in kept if u @ v >= at_least), i)
        if out[i] == i:
            kept.append((i, v))
    return out


def clustered(rng, clusters, most, spread, size=24):
    rows = []
    for _ in range(clusters):
        middle = rng.standard_normal(size)
        for _ in range(rng.integers(1, most + 1)):
            rows.append((middle + spread * rng.standard_normal(size) * np.linalg.norm(middle) / size ** 0.5).astype(np.float32).tolist())
    order = rng.permutation(len(rows))
    return [(int(i), rows[at]) for i, at in enumerate(order)]


def found(frame):
    return {r.vec_id: r.representative for r in frame.collect()}


def test_against_all_pairs(spark):
    """Copies, a group of several hundred near-copies over many stretches, and vectors of their own."""
    rng = np.random.default_rng(1)
    rows = clustered(rng, 60, 4, 0.08) + [(1000 + i, v) for i, v in clustered(rng, 1, 1, 0.0)]
    crowd = rng.standard_normal(24)
    rows += [(2000 + i, (crowd + 0.05 * rng.standard_normal(24)).astype(np.float32).tolist()) for i in range(500)]
    rows += [(5000 + i, rows[i % 3][1]) for i in range(50)] + [(9000 + i, v) for i, v in clustered(rng, 80, 2, 0.08)]
    rows += [(20, None), (10_000, None), (10_001, []), (10_002, [0.0] * 24), (10_003, [1.0] * 7), (10_004, [float("nan")] * 24), (10_005, [None] + [1.0] * 23)]
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, LAYOUT).repartition(5)
    got = vectors.drop_close(df, S)
    assert found(got) == greedy(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.representative) for r in got.collect())


def test_recall_of_links_near_the_limit(spark):
    rng = np.random.default_rng(2)
    rows = clustered(rng, 150, 5, 0.5, 64)
    unit = np.array([v for _, v in rows], float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    every = {(min(a, b), max(a, b)) for a, b in zip(*(ids[x] for x in np.nonzero(np.triu(unit @ unit.T >= 0.75, 1))))}
    got = {(r.earlier, r.later) for r in vectors.vector_links(spark.createDataFrame(rows, LAYOUT), S, 0.75).collect()}
    assert got <= every and len(every) > 100 and len(got) >= 0.95 * len(every)


@pytest.mark.parametrize("n", [100, 10**6, 10**10])
def test_tables_keep_the_recall(n):
    for limit in (0.6, 0.8, 0.9, 0.95):
        tables, bits = vectors.tables_for(n, limit)
        same = 1 - np.arccos(limit) / np.pi
        assert 1 <= tables <= vectors.MOST_TABLES and 1 - (1 - same ** bits) ** tables >= vectors.RECALL


def test_split_buckets_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CROWD", 3)
    rows = clustered(np.random.default_rng(3), 20, 8, 0.05)
    assert found(vectors.drop_close(spark.createDataFrame(rows, LAYOUT), S)) == greedy(rows, 0.9)


def test_tight_budget_gives_the_same(spark):
    rows = clustered(np.random.default_rng(4), 90, 3, 0.08)
    tight = S.with_(fold_rows=16, pair_budget=1, pairs_per_title=0)
    assert found(vectors.drop_close(spark.createDataFrame(rows, LAYOUT), tight)) == greedy(rows, 0.9)


def test_nothing_to_compare(spark):
    assert found(vectors.drop_close(spark.createDataFrame([], LAYOUT), S)) == {}
    rows = [(1, None), (2, [0.0, 0.0]), (3, [])]
    assert found(vectors.drop_close(spark.createDataFrame(rows, LAYOUT), S)) == {1: 1, 2: 2, 3: 3}
    assert found(vectors.drop_close(spark.createDataFrame([(1, [2.0, 1.0])], LAYOUT), S)) == {1: 1}
    clash = spark.createDataFrame([(1, [2.0, 1.0], 5), (2, [4.0, 2.1], 6)], LAYOUT + ", kept int")
    assert found(vectors.drop_close(clash, S)) == {1: 1, 2: 1}


def test_what_is_shuffled_for_an_item_stops_growing():
    for limit in (0.8, 0.9):
        assert vectors.tables_for(10**5, limit) == vectors.tables_for(10**8, limit)


def test_sketches_rule_out_what_is_not_close(spark):
    """All pairs at the limit pass, hardly any of unrelated vectors do."""
    rng = np.random.default_rng(5)
    a, b, other = rng.standard_normal((3, 400, 48))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    near = 0.9 * a + (1 - 0.9 ** 2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = spark.createDataFrame([(3 * i + k, v[i].tolist()) for i in range(400) for k, v in enumerate((a, near, other))], "_rank long, _vector array<double>")
    marks = {r[0]: r[1:] for r in vectors._hashed(rows, 48, 1, 1, 3).select("_rank", *vectors._sketch()).collect()}
    apart = lambda x, y: sum(bin((p ^ q) % 2**64).count("1") for p, q in zip(marks[x], marks[y]))
    assert all(apart(3 * i, 3 * i + 1) <= vectors.most_apart(0.9) for i in range(400))
    assert sum(apart(3 * i, 3 * i + 2) <= vectors.most_apart(0.9) for i in range(400)) <= 2
