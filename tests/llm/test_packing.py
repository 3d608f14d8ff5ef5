import random
import zlib

import numpy as np
import pytest

from digestry.llm import packing




def placed(counts, plan):
    out = {}
    for size, lots in plan.lots.items():
        edges = [x[0] for x in lots[1:]] + [int(counts[size])]
        for (first, start, each, begin), to in zip(lots, edges):
            for rank in range(first, to):
                out.setdefault(start + (rank - first) // each, []).append((begin + (rank - first) % each * size, size))
    return out


def best_fit_decreasing(sizes, length):
    room = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= s]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= s
        else:
            room.append(length - s)
    return len(room)


@pytest.mark.parametrize("seed", range(60))
def test_plans(seed):
    random.seed(seed)
    length = random.choice([10, 24, 60])
    sizes = [random.randint(1, length) if seed % 3 else random.randint(length // 3, length) for _ in range(random.randint(0, 120))]
    if seed % 5 == 0:
        sizes += [random.randint(1, length)] * 100
    counts = np.bincount(sizes, minlength=length + 1) if sizes else np.zeros(length + 1, np.int64)
    plan = packing.plan_packing(counts, length)
    found = placed(counts, plan)
    assert sorted(s for rows in found.values() for _, s in rows) == sorted(sizes)
    assert sorted(found) == list(range(plan.sequences))
    for rows in found.values():
        at = 0
        for offset, size in sorted(rows):
            assert offset == at
            at += size
        assert at <= length
    least = -(-sum(sizes) // length)
    assert least <= plan.sequences <= max(best_fit_decreasing(sizes, length), least)


def optimum(sizes, length):
    """Fewest bins by trying everything."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for j in {r: k for k, r in enumerate(rooms)}.values():
            if rooms[j] >= sizes[i]:
                go(i + 1, rooms[:j] + [rooms[j] - sizes[i]] + rooms[j + 1:])
        go(i + 1, rooms + [length - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_what_dominance_fixes_is_part_of_an_optimum(seed):
    random.seed(seed)
    length = 20
    sizes = [random.randint(4, 20) for _ in range(9)]
    counts = np.bincount(sizes, minlength=length + 1)
    plan = packing.plan_packing(counts, length)
    found = placed(counts, plan)
    rest = [s for k in range(plan.fixed, plan.sequences) for _, s in found[k]]
    assert plan.fixed + optimum(rest, length) == optimum(sizes, length)


ROWS = [(1, "a few words"), (2, None), (3, ""), (4, "word " * 300), (4, "word " * 300), (5, "<|endoftext|> it's  odd\n\n\ttext é 日本"), (None, "no id"), *((i, "the same text") for i in range(10, 40))]


def test_pieces_and_places(spark, monkeypatch):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "RUN", 7)
    made = Tokenizer.from_file(path("byte_bpe_50k.json"))
    made.encode_special_tokens = True
    docs = spark.createDataFrame([(*r, "x", 0) for r in ROWS], "doc_id long, text string, length string, sequence_id int")
    pieces = packing.tokenised(docs, length=64).collect()
    by = {}
    for p in pieces:
        by.setdefault((p.doc_id, p.piece), []).append(p)
    for doc, text in ROWS:
        ids = made.encode(text or "", add_special_tokens=False).ids + [0]
        head = len(ids) % 64 or 64
        edges = [0, *range(head, len(ids), 64), len(ids)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            assert all((p.start, p.length, np.frombuffer(p.ids, "<u4").tolist()) == (a, b - a, ids[a:b]) for p in by[doc, k])
    placed_ = packing.place(packing.tokenised(docs, length=64), 64, run=7).collect()
    assert len(placed_) == len(pieces)
    rows = {}
    for r in placed_:
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in rows.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 64
    whole = packing.sequences(spark.createDataFrame(placed_, packing.place(packing.tokenised(docs, length=64), 64).schema)).collect()
    assert sum(len(r.ids) for r in whole) == 4 * sum(p.length for p in pieces)
    packed = packing.pack(docs, length=64).collect()
    crc = {(p.doc_id, p.piece): zlib.crc32(bytes(p.ids)) for p in pieces}
    assert all(crc[r.doc_id, r.piece] == r.ids_crc32 for r in packed)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_added_tokens_as_the_unaltered_tokenizer_gives_them(spark, tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    from digestry.llm.queries import op3_best_fit

    made = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>x", "no <|endoftext |>", "end<|endoftext|>", None, "plain  text\n\n é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = [np.array(made.encode(t or "", add_special_tokens=False).ids + [0], "<u4") for t in texts]
    assert ids[0].tolist() == [64, 220, 50256, 275, 0]
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.tokenised(docs, added=True).collect()}
    assert got == {i: x.tolist() for i, x in enumerate(ids)}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.ids_crc32 for r in op3_best_fit(spark, str(tmp_path)).collect()} == {i: zlib.crc32(x.tobytes()) for i, x in enumerate(ids)}
