import random
from collections import Counter

import pytest
from helpers import WORD

from digestry.llm import line_dedup as L


BLANKS = " \t\n\x0b\x0c\r"


def longest(values):
    best = [1] * len(values)
    for i in range(len(values)):
        best[i] += max([best[j] for j in range(i) if values[j] < values[i]], default=0)
    return max(best, default=0)


@pytest.mark.parametrize("seed", range(20))
def test_longest_rise(seed):
    random.seed(seed)
    values = random.sample(range(100), random.randint(0, 30))
    found = L.longest_rise(values)
    assert len(found) == longest(values) and all(a < b and values[a] < values[b] for a, b in zip(found, found[1:]))


def plain(docs, min_words, rare=8):
    """{id: (text that stays, lines removed)} by holding each document against every earlier one, line by line."""
    rows, single, df = {}, {}, Counter()
    for i, t in docs:
        rows[i] = [(p, x.strip(BLANKS), len(WORD.findall(x))) for p, x in enumerate((t or "").split("\n")) if WORD.search(x)]
        times = Counter(x for _, x, _ in rows[i])
        single[i] = {x: n for n, (_, x, _) in enumerate(rows[i]) if times[x] == 1}
        df.update(x for _, x, k in rows[i] if times[x] == 1 or k >= min_words)
    held_by = {}
    for i in rows:
        for x in {x for _, x, _ in rows[i]}:
            held_by.setdefault(x, []).append(i)
    out = {}
    for i, t in docs:
        mine, gone = rows[i], set()

        def take(first, last):
            if sum(k for _, _, k in mine[first:last + 1]) >= min_words:
                gone.update(range(first, last + 1))

        for e in {e for _, x, _ in mine for e in held_by[x] if e < i}:
            theirs = [x for _, x, _ in rows[e]]
            where = {}
            for n, x in enumerate(theirs):
                where.setdefault(x, []).append(n)
            for n in range(len(mine)):  # runs without other lines between them, from each pair of places
                for m in where.get(mine[n][1], ()):
                    if not (n and m and mine[n - 1][1] == theirs[m - 1]):
                        k = 0
                        while n + k < len(mine) and m + k < len(theirs) and mine[n + k][1] == theirs[m + k]:
                            k += 1
                        take(n, n + k - 1)
            at = [single[e][x] if x in single[i] and x in single[e] and df[x] <= rare else None for _, x, _ in mine]
            n = 0
            while n < len(mine):  # rare lines in the same order
                k = n
                while at[n] is not None and k + 1 < len(mine) and at[k + 1] is not None and at[k + 1] > at[k]:
                    k += 1
                if at[n] is not None:
                    take(n, k)
                n = k + 1
        lost, n = set(), 0
        while n < len(mine):
            k = n
            while n in gone and k + 1 in gone:
                k += 1
            if n in gone:
                lost.update(range(mine[n][0], mine[k][0] + 1))
            n = k + 1
        out[i] = "\n".join(x for p, x in enumerate((t or "").split("\n")) if p not in lost), len(lost)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_plain_version(spark, seed):
    random.seed(seed)
    line = lambda: " ".join(random.choices("abcdefgh", k=random.choice([1, 3, 8, 30])))
    pool = [[line() for _ in range(random.randint(1, 6))] for _ in range(12)]
    docs = []
    for i in range(80):
        rows = []
        for _ in range(random.randint(0, 4)):
            rows += random.choice(pool) if random.random() < 0.6 else [line(), "", " " + line() + " "]
        if random.random() < 0.2:
            random.shuffle(rows)
        docs.append((i, "\n".join(rows)))
    names = ("kept", "removed", "text_key", "first", "hash", "a", "df", "kind")
    rows = spark.createDataFrame([(*d, "x", *names) for d in docs], "doc_id long, text string, removed_lines string, " + ", ".join(f"{n} string" for n in names))
    result = L.dedup_lines(rows.repartition(5), 20)
    assert set(result.columns) == {"doc_id", "text", "removed_lines", *names}
    rows = result.collect()
    assert {r.doc_id: (r.text, r.removed_lines) for r in rows} == plain(docs, 20)
    assert all(r[n] == n for r in rows for n in names)


@pytest.mark.parametrize("limits", [{"rare": 2, "hot": 3}, {"rare": 2, "hot": 3, "sent": 0}, {"rare": 1, "hot": 1}])
def test_limits_of_rare_and_frequent_lines(spark, limits):
    """Contiguous blocks go whatever counts as rare, and whichever way frequent lines are joined."""
    random.seed(9)
    pool = [" ".join(random.choices("abcdefgh", k=12)) for _ in range(25)]
    docs = [(i, "\n".join(pool[(s := random.randrange(20)):s + random.randrange(2, 6)] + [f"own line {i}"])) for i in range(60)]
    frame = spark.createDataFrame([(i, 0, t) for i, t in docs], "doc_id long, text_key long, text string")
    got = {r.doc_id: r.removed for r in L.common_blocks(frame, 20, **limits).collect()}
    assert got == {i: n for i, (_, n) in plain(docs, 20, limits["rare"]).items() if n}


def test_a_copy_goes_although_its_lines_are_elsewhere_in_another_order(spark):
    lines = [f"one two three four line{i}" for i in range(10)]
    turned = lines[::-1]
    docs = [(1, "\n".join(turned)), (2, "\n".join(lines)), (3, "\n".join(lines))]
    got = {r.doc_id: (r.text, r.removed_lines) for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == (docs[0][1], 0) and got[2] == (docs[1][1], 0) and got[3] == ("", 10)
    # The same with so many copies that their lines make no pairs.
    docs += [(i, docs[2][1]) for i in range(4, 40)]
    got = {r.doc_id: r.removed_lines for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0} | {i: 10 for i in range(3, 40)}


def test_text_without_a_common_block_stays(spark):
    """Six documents have a line each in common with a seventh, none of them a block."""
    lines = [f"some words of line {i}" for i in range(6)]
    docs = [(i, f"{x}\nown text of {i}") for i, x in enumerate(lines)] + [(10, "\n".join(lines))]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict(docs)


def test_a_line_put_in_between(spark):
    """Aligned lines make a block in the later document although the earlier one has a line more."""
    lines = [f"words of a shared passage {i}" for i in range(6)]
    docs = [(1, "\n".join([*lines[:3], "inserted", *lines[3:]])), (2, "\n".join(["start", *lines, "end"]))]
    got = {r.doc_id: r.text for r in L.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: "start\nend"}


def test_odd_rows(spark):
    long = "this passage has more than twenty words " * 4
    rows = [(None, long), (None, None), (3, long), (2, None), (1, ""), (5, f"start\n{long}\nend\n"), (5, f"start\n{long}\nend\n"), (5, f"x\n\n{long}"), (7, f"{long}\n{long}"),
            (8, "short line\nshort line"), (9, "short line"), (10, long), (11, ("y" * 10 + " ") * 30_000), (12, ("y" * 10 + " ") * 30_000)]
    got = L.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(map(key, got)) == sorted(map(key, [
        (None, long), (None, None), (3, long), (2, None), (1, ""), (5, "start\nend\n"), (5, "start\nend\n"), (5, "x\n"), (7, ""),
        (8, "short line\nshort line"), (9, "short line"), (10, ""), (11, ("y" * 10 + " ") * 30_000), (12, "")]))
    assert L.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []
