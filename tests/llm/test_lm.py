import math
import os
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import words
from pyspark.sql import functions as F

from digestry.llm import lm


def texts():
    random.seed(2)
    tongues = [["%s%d" % (c, i) for i in range(60)] for c in "xyz"]
    out = [" ".join(random.choices(random.choice(tongues), weights=range(60, 0, -1), k=random.randint(0, 120))) for _ in range(400)]
    return [*out, None, "", "never seen WORDS", "X1 x1 X1"]


def learn():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 != 2


@pytest.mark.parametrize("known", [1 << 18, 20])
def test_counts_and_base_scores(spark, monkeypatch, known):
    monkeypatch.setattr(lm, "VOCABULARY", 0)
    monkeypatch.setattr(lm, "LEAST_VOCABULARY", 10)
    monkeypatch.setattr(lm, "frequent", lambda counts, most=known, f=lm.frequent: f(counts, most))
    docs = [*enumerate(texts()), (None, "x1 y1"), (3, texts()[3])]
    rows = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, tail string, score int")
    got = lm.score(rows, learn()).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    count = Counter(w for i, t in docs if not held(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    for i, t in docs:
        own, r = [*words(t), None], by[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(own), sum(count[w] > 0 for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in own), rel=1e-9)


def test_model_is_normalised_and_better_than_its_base(spark):
    docs = spark.createDataFrame([*enumerate(texts())], "doc_id long, text string").repartition(2)
    counts = lm.word_counts(docs.where(learn()))
    known = lm.frequent(counts)
    model = lm.train(docs.where(learn()), known)
    p = np.exp(model.context @ model.target.T + model.bias - lm.normalisers(spark, model, 7)[:, None])
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    total = lm.score(docs, learn()).groupBy("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).collect()
    assert len(total) == 2 and all((r.score - r.base) / r.n > 0.01 for r in total)


def ending(word):
    if word is None:
        return 0
    raw = word.encode()
    return (raw[-1] * 7919 + raw[-2 if len(raw) > 1 else -1] * 104729) % 65521 % lm.CLASSES


@pytest.mark.parametrize("own, known", [(1024, 1 << 18), (25, 1 << 18), (25, 40)])
def test_score_against_plain_sums(spark, monkeypatch, own, known):
    """Every token's probability from the parameters, word by word; all words and an unseen one of each class sum to one."""
    monkeypatch.setattr(lm, "VOCABULARY", 0)
    monkeypatch.setattr(lm, "LEAST_VOCABULARY", own)
    monkeypatch.setattr(lm, "frequent", lambda counts, most=known, f=lm.frequent: f(counts, most))
    made = []
    monkeypatch.setattr(lm, "train", lambda *a, f=lm.train: made.append(f(*a)) or made[-1])
    docs = list(enumerate(texts()))
    got = {r.doc_id: r for r in lm.score(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), learn()).collect()}
    model, held = made[0], lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in docs if not held(i) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    hashes = {}
    for *_, tokens, _, bounds in lm._tokens(pa.array([w or "" for w in count])):
        hashes = {w: tokens[bounds[k]] for k, w in enumerate(count)}
    number = {w: int(model.of_tokens(np.array([hashes[w]]), np.array([ending(w)]))[0]) for w in count}
    classes = {w: number[w] - model.own for w in count if number[w] >= model.own}
    assert len(count) - len(classes) == min(own, len(count))
    assert min(count[w] for w in count if w not in classes) >= max((count[w] for w in classes), default=0)
    assert all(classes[w] == ending(w) for w in classes)
    of_class = Counter()
    for w, c in classes.items():
        of_class[c] += count[w] + 1

    def chance(before, w):
        scores = model.target.astype(float) @ model.context[before].astype(float) + model.bias
        scores = np.exp(scores - scores.max())
        at = number.get(w, model.own + ending(w))
        part = 1.0 if at < model.own else (count[w] + 1) / (of_class[at - model.own] + 1)
        return lm.SHARE * scores[at] / scores.sum() * part + (1 - lm.SHARE) * (count[w] + 1) / (n + v + lm.CLASSES)

    for i, t in docs[::9] + docs[-4:]:
        before, total = model.start, 0.0
        for w in [*words(t), None]:
            total += math.log10(chance(before, w))
            before = number.get(w, model.own + ending(w))
        assert got[i].score == pytest.approx(total, rel=1e-4)
    unseen = sum(lm.SHARE * 1 / (of_class[c] + 1) * p for c, p in enumerate(_class_chances(model, 3)))
    assert sum(chance(3, w) for w in count) + unseen + (1 - lm.SHARE) * lm.CLASSES / (n + v + lm.CLASSES) == pytest.approx(1, abs=1e-4)


def _class_chances(model, before):
    scores = np.exp(model.target.astype(float) @ model.context[before].astype(float) + model.bias)
    return (scores / scores.sum())[model.own:]


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.01"), reason="no test data")
def test_splits_do_not_cost_what_is_learned(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    gain = {}
    for splits in (1, 64):
        r = lm.score(docs.repartition(splits), learn()).where("held_out").agg(((F.sum("score") - F.sum("base_score")) / F.sum("n_tokens")).alias("g")).first()
        gain[splits] = r.g
    print(gain)
    assert gain[64] > 0.05 and abs(gain[64] - gain[1]) < 0.02


def test_no_lessons_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score(docs, F.lit(False)).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in sorted(got)] == [(True, 3, 0, 0, 0.0), (True, 1, 0, 0, 0.0)]
    assert lm.score(docs.limit(0), learn()).collect() == []


def test_counts_that_flow_over(spark):
    docs = spark.createDataFrame([(" ".join("w%d" % (i * j % 97) for j in range(50)),) for i in range(60)], "text string").coalesce(1)
    plain = Counter(w for r in docs.collect() for w in [*words(r.text), None])
    got = sorted(r.n for r in lm.word_counts(docs, keep=40).collect())
    assert got == sorted(plain.values())


def plain_step(trainer, before, after):
    """One step by the formulas alone, every intermediate result an array of its own."""
    m, n = trainer.model, len(after)
    noise = np.minimum(np.searchsorted(trainer.edges, trainer.random.random(lm.NOISE)), len(trainer.edges) - 1)
    h, t, z = m.context[before], m.target[after], m.target[noise]
    shift = np.float32(np.log(lm.NOISE))
    real = np.einsum("ij,ij->i", h, t) + m.bias[after] - m.log_noise[after] - shift
    fake = h @ z.T + (m.bias[noise] - m.log_noise[noise] - shift)
    lack, excess = -1 / (1 + np.exp(np.clip(real, -30, 30))), 1 / (1 + np.exp(-np.clip(fake, -30, 30)))
    both, scale = np.concatenate([after, noise]), np.float32(1 / np.sqrt(n))
    slopes = [(m.context, before, lack[:, None] * t + excess @ z), (m.target, both, np.concatenate([lack[:, None] * h, excess.T @ h])),
              (m.bias, both, np.concatenate([lack, excess.sum(0)]))]
    for values, past, (_, keys, slope) in zip((m.context, m.target, m.bias), trainer.past, slopes):
        sums = np.zeros_like(values)
        np.add.at(sums, keys, slope)
        at = np.unique(keys)
        past[at] += (sums[at] * scale) ** 2
        values[at] -= trainer.rate * (sums[at] * scale) / np.sqrt(past[at])
    np.add.at(trainer.met[0], before, 1)
    np.add.at(trainer.met[1], both, 1)


def test_quick_steps_are_those_of_the_formulas():
    """A task that learns chunk by chunk ends with the parameters, and the numbers of meetings, of single plain steps."""
    random = np.random.default_rng(3)
    keys = np.sort(random.integers(-2**62, 2**62, 3000))
    n = random.integers(1, 50, 3000)
    classes = random.integers(0, lm.CLASSES, 3000).astype(np.int32)
    counts = lm.Counts(keys, n, classes, int(n.sum()), 3000, np.bincount(classes, n + 1, lm.CLASSES).astype(np.int64))
    model = lm.untrained(counts)
    quick, plain = lm._Trainer(model, 0.15), lm._Trainer(model, 0.15)
    after = random.integers(0, 200, 5000).astype(np.int32)
    before = np.roll(after, 1)
    quick.learn(before[:3200], after[:3200], 640)
    quick.learn(before[3200:], after[3200:], 640)
    for at in range(0, 5000, 640):
        plain_step(plain, before[at:at + 640], after[at:at + 640])
    for name in ("context", "target", "bias"):
        assert np.allclose(getattr(quick.model, name), getattr(plain.model, name), rtol=1e-4, atol=1e-5)
    assert all((a == b).all() for a, b in zip(quick.met, plain.met))


def test_places_of_words():
    """Tokens are looked up once for ids and counts; unknown ones have no place and go to their class."""
    keys = np.array([-9, 4, 7], np.int64)
    counts = lm.Counts(keys, np.array([3, 9, 1]), np.zeros(3, np.int32), 13, 3, np.zeros(lm.CLASSES, np.int64) + 20)
    model = lm.untrained(counts)
    tokens, classes = np.array([7, 5, -9, 4]), np.array([0, 2, 0, 0])
    places = model.finder().get(tokens, np.int32(-1))
    assert places.tolist() == [2, -1, 0, 1]
    assert model.of_tokens(tokens, classes, places).tolist() == model.of_tokens(tokens, classes).tolist() == [2, model.own + 2, 1, 0]
