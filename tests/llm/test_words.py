import pickle
import random

import numpy as np
import pyarrow as pa
import pytest

from digestry.llm import words as W
from helpers import shingles, words

TEXTS = ["", None, "one", " a  b\tc\x0bd ", "Ärger A b Z", "x" * 5000 + " y", "a b c d e", "a b c d e f a b c d e f", "\n\n", "tail "]


@pytest.mark.parametrize("size", [1, 8, 1 << 20])
def test_words_and_shingles(size):
    random.seed(size)
    texts = TEXTS + ["".join(random.choices("aB é\n\t　", k=random.randint(0, 60))) for _ in range(200)]
    column = pa.array(texts)
    seen, ids, sizes = [], {}, []
    for found in W.words(column, size):
        for k in range(found.last - found.first):
            at = range(found.bounds[k], found.bounds[k + 1])
            own = [found.text(i) for i in at]
            seen.append([w.translate({c: c + 32 for c in range(65, 91)}) for w in own])
            for i, w in zip(at, seen[-1]):
                assert ids.setdefault(w, found.hashes[i]) == found.hashes[i]
        sizes += np.diff(W.shingle_sets(found)[1]).tolist()
    assert seen == [words(t) for t in texts]
    assert len(set(ids.values())) == len(ids)
    assert sizes == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("size", [1, 1 << 20])
def test_lines(size):
    random.seed(3)
    texts = ["", None, "a\n\nb c\n", "\n x \n x\ty", *("".join(random.choices("ab \n", k=30)) for _ in range(200))]
    seen, hashes = [], {}
    for found in W.lines(pa.array(texts), size):
        for k in range(found.last - found.first):
            a, b = found.bounds[k], found.bounds[k + 1]
            all_ = (texts[found.first + k] or "").split("\n")
            assert found.totals[k] == len(all_)
            assert found.places[a:b].tolist() == [i for i, x in enumerate(all_) if x.strip()]
            assert found.n_words[a:b].tolist() == [len(x.split()) for x in all_ if x.strip()]
            for h, i in zip(found.hashes[a:b], found.places[a:b]):
                assert hashes.setdefault(all_[i].strip(), h) == h
            seen.append(b - a)
    assert len(seen) == len(texts) and len(set(hashes.values())) == len(hashes)


def test_sliced_batches_and_lookup():
    column = pa.array(["aa", "b c", None, "d"]).slice(1, 3)
    assert [len(f.hashes) for f in W.words(column, 1 << 20)] == [3]
    keys = W.as_signed(W.mix(np.arange(1000, dtype=np.uint64)))
    table = W.Lookup(keys, np.arange(1000))
    assert table.get(keys, -1).tolist() == list(range(1000))
    assert table.get(W.as_signed(W.mix(np.arange(1000, 1100, dtype=np.uint64))), -1).tolist() == [-1] * 100
    assert W.Lookup(keys[:0], keys[:0]).get(keys[:3], 7).tolist() == [7] * 3


def test_lookup_is_small():
    """Whatever the number of keys, a table takes at most 8 bytes beside each key and value, sent or not; any equal last bits do."""
    for n in (1100, 2047, 2048, 5000):
        keys = W.as_signed(W.mix(np.arange(n, dtype=np.uint64)))
        keys[0], keys[1] = -(1 << 63), 0
        made = W.Lookup(keys, np.arange(n, dtype=np.float32))
        for table in (made, pickle.loads(pickle.dumps(made))):
            assert table.get(keys, -1).tolist() == list(range(n))
            assert sum(x.nbytes for x in vars(table).values() if isinstance(x, np.ndarray)) <= n * (8 + 4 + 8) + 100
    crowded = W.Lookup(np.arange(50, dtype=np.int64) << 40, np.arange(50))
    assert crowded.get(np.arange(60, dtype=np.int64) << 40, -1).tolist() == [*range(50), *[-1] * 10]
