import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from digestry.llm import align

sys.path.insert(0, "/opt/tokenizers")
P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def encoders():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}

    def tokens(text):
        e = a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(byte[c] for c in t)) for i, t in zip(e.ids, e.tokens)]
        two = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            two.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (one, two) if text and b"".join(x for _, x in one) == raw == b"".join(x for _, x in two) else ([], [])
    return tokens


def plain(rows, tokens):
    """Every column by walking over bytes."""
    made, counts = [], Counter()
    for doc, text in rows:
        one, two = tokens(text or "")
        ends = []
        for side in (one, two):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at := at + len(x)))
            ends.append(out)
        cuts = sorted({e for _, _, e in ends[0]} & {e for _, _, e in ends[1]})
        groups, links = [], []
        for low, high in zip([0, *cuts], cuts):
            groups.append("|".join(",".join(str(i) for i, s, e in side if low <= s and e <= high) for side in ends))
        links = [(i, j) for i, _, e in ends[0] for j, _, f in ends[1] if e == f] if len(one) < 3000 else list(zip(
            [i for i, _, e in ends[0] if e in set(cuts)], [j for j, _, e in ends[1] if e in set(cuts)]))
        counts.update(links)
        made.append((doc, len(one), len(two), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if one else ""))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    return sorted(((doc, a, b, g, len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x), h) for doc, a, b, g, x, h in made), key=repr)


def corpus():
    rng = random.Random(4)
    parts = ["hello", " world", "  ", "\n", "\t", "été", "数据", "😀", "<|endoftext|>", "<s>", "<0x0A>", " the", " of", "ing", "　", "\x00", "!!", "12345"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(40)))) for i in range(120)]
    return rows + [(1, "hello world"), (1, "hello world"), (None, "the end of the end"), (5, None), (6, ""), (7, "a ▁ b"), (8, " "), (9, " lead and trail "), (10, "of the thing " * 900)]


def found(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("frequent", [align.FREQUENT, 5, 0])
def test_against_plain(spark, encoders, frequent):
    rows = corpus()
    assert found(align.align_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), frequent=frequent)) == plain(rows, encoders)


def test_empty_table_and_clashing_names(spark, encoders):
    assert found(align.align_tokens(spark.createDataFrame([], SCHEMA))) == []
    rows = corpus()[100:]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("key", "pairs", "times", "n", "n_a", "best", "pair"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(align.align_tokens(docs)) == plain(rows, encoders)
    assert found(align.align_tokens(spark.createDataFrame([(1, None), (2, "▁")], SCHEMA))) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_groups_and_overlaps_of_intervals():
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(1, 40)
        a, b = (sorted({*(rng.randrange(1, n + 1) for _ in range(rng.randrange(12))), n}) for _ in range(2))
        sides = [np.array([[0, *x[:-1]], x]) for x in (a, b)]
        side = np.repeat([0, 1], [len(a), len(b)])
        order, group = align.coalesce(np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]), side)
        ends = np.concatenate([s[1] for s in sides])[order]
        assert [max(ends[group == g]) for g in range(group[-1] + 1)] == sorted(set(a) & set(b))
        got = set(zip(*map(list, align.overlaps(*sides[0], *sides[1]))))
        assert got == {(i, j) for i in range(len(a)) for j in range(len(b)) if sides[0][0][i] < sides[1][1][j] and sides[1][0][j] < sides[0][1][i]}


def test_links_of_all_overlaps(spark):
    docs = spark.createDataFrame([(1, "unbelievable internationalisation")], SCHEMA)
    row = align.aligned(docs, ending=False).first()
    assert row.n_links >= row.n_a + row.n_b - row.n_groups
