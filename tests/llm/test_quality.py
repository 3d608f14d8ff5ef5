import math
import os
import pickle
import random
import weakref
from collections import Counter, defaultdict

import pytest
from helpers import words
from pyspark.sql import functions as F

from digestry.llm import quality as Q

TABLES = "/root/testdata/sf0.1"


class Plain:
    """Interpolated modified Kneser-Ney with dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, []
        top = Counter(g for t in texts for g in self.grams(t, order))
        self.counts.insert(0, top)
        for n in range(order - 1, 0, -1):
            # An n-gram at a text's start is as long as it gets; its endings keep what stands before them.
            lower = Counter()
            for g in self.counts[0]:
                lower[g[1:] if len(g) == n + 1 else g] += 1
            self.counts.insert(0, lower)
        self.d, self.total, self.kinds = [], [], []
        for table in self.counts:
            n = Counter(table.values())
            y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0.5
            raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] and n[k + 1] else 0.5 * k for k in (1, 2, 3)]
            self.d.append([min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), raw)])
            total, kinds = Counter(), defaultdict(Counter)
            for g, c in table.items():
                total[g[:-1]] += c
                kinds[g[:-1]][min(c, 3)] += 1
            self.total.append(total)
            self.kinds.append(kinds)

    @staticmethod
    def grams(text, order):
        w = ["<s>", *words(text), "</s>"]
        return [tuple(w[max(0, i - order + 1):i + 1]) for i in range(1, len(w))]

    def p(self, gram):
        return self._p(gram, self.order)

    def _p(self, gram, n):
        gram = gram[-n:]
        table, d = self.counts[n - 1], self.d[n - 1]
        if n == 1:
            spared = sum(d[k - 1] * v for k, v in self.kinds[0][()].items())
            share = table[gram] - d[min(table[gram], 3) - 1] if table[gram] else 0
            return (share + spared / (len(table) + 1)) / self.total[0][()]
        low = self._p(gram[1:] if len(gram) == n else gram, n - 1)
        total = self.total[n - 1][gram[:-1]]
        if not total:
            return low
        c = table[gram]
        rest = sum(d[k - 1] * v for k, v in self.kinds[n - 1][gram[:-1]].items())
        return ((c - d[min(c, 3) - 1] if c else 0) + rest * low) / total


@pytest.mark.parametrize("order", [1, 2])
def test_probabilities(spark, order):
    random.seed(4)
    texts = [" ".join(random.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=random.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model, plain = Q.train(docs, order), Plain(texts, order)
    asked = ["a b a z", "h h h", "", None, *texts[:5]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = {r.doc_id: r for r in Q.score(rows, model, model, ("doc_id",), order).collect()}
    for i, t in enumerate(asked):
        grams = plain.grams(t, order)
        assert got[i].n_tokens == len(grams)
        assert got[i].log10_trusted == pytest.approx(sum(math.log10(plain.p(g)) for g in grams), rel=1e-5)
        assert got[i].gain == pytest.approx(0, abs=1e-5)
    for context in ([], ["a"], ["h"]):
        ends = [*"abcdefgh", "</s>"]
        known = sum(plain.p(("<s>", *context, w)[-order:]) for w in ends)
        assert 0.9 < known < 1  # the rest is for unseen words


def corpus():
    random.seed(9)
    clean = ["".join(random.choices("klmnop", k=3)) for _ in range(200)]
    rude = ["rude%d" % i for i in range(6)]
    docs, labels = [], []
    for i in range(600):
        lang = random.choice(["en", "fr"])
        text = random.choices(clean, k=random.randint(40, 200))
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text[random.randrange(len(text))] = random.choice(rude)
        docs.append((i, " ".join(text), lang, toxic))
        if i < 300:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_rejects_bad_and_keeps_clean_documents(spark):
    docs, labels = corpus()
    more = [(1000, None, "en", False), (1001, "", None, False), (None, docs[1][1], "xx", False), (1, docs[1][1], "en", False), (1002, docs[1][1] * 300, "en", False),
            (1003, " ".join(["zzz"] * 400), "en", True)]
    rows = spark.createDataFrame([(*r[:3], "clash", 1.0) for r in docs + more], "doc_id long, text string, lang string, kept string, limit double")
    got = Q.classify(rows, spark.createDataFrame(labels + [(1, 1, None), (None, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(docs) + len(more)
    bad = {r[0] for r in docs + more if r[3]}
    assert {r.doc_id for r in got if not r.kept} == bad
    odd = {r.doc_id: r for r in got}
    assert odd[1000].perplexity is None and odd[1000].kept and odd[1001].kept and odd[None].kept


@pytest.mark.parametrize("labels", [[], [(1, 0, 0)], [(1, 1, 0)], [(None, None, None)]])
def test_few_or_no_labels(spark, labels):
    docs = spark.createDataFrame([(1, "a b c", "en"), (2, "d", None), (3, None, "en")], "doc_id long, text string, lang string")
    got = Q.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 3 and all(r.kept for r in got)
    assert Q.classify(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect() == []


def test_length_does_not_thin_out_a_bad_passage(spark):
    docs, labels = corpus()
    random.seed(10)
    known = " ".join(t for _, t, _, toxic in docs[:100] if not toxic).split()
    long = [random.choices(known, k=60_000) for _ in range(4)]
    for text in long[:2]:
        text[1000:1020:2] = ["rude%d" % (i % 6) for i in range(10)]
    rows = docs + [(2000 + i, " ".join(t), "en", i < 2) for i, t in enumerate(long)]
    got = {r.doc_id: r for r in Q.classify(spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic boolean"),
                                           spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert [got[2000 + i].kept for i in range(4)] == [False, False, True, True]
    assert got[2000].strangeness <= got[2000].limit and got[2000].peak > got[2000].peak_limit


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the test tables")
def test_held_out_bad_labels(spark):
    """Half of the bad labels and a fifth of the trusted ones are not given; most of these bad documents go, the trusted stay."""
    docs, labels = (spark.read.parquet(f"{TABLES}/{name}.parquet") for name in ("documents", "labels"))
    bad = F.expr("quality = 0 or toxic = 1")
    aside = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(10)) < F.when(bad, 5).otherwise(2)
    kept = Q.classify(docs, labels.where(~aside)).select("doc_id", "kept")
    of = {(r.quality, r.toxic): r for r in labels.where(aside).join(kept, "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    print(of)
    assert of[1, 0].kept >= 0.98
    assert of[1, 1].kept <= 0.15 and of[0, 0].kept <= 0.10


def test_carried_columns_of_any_name(spark):
    """No column that is carried meets one used inside, and `lang` need not be carried."""
    docs = [(i, "some plain words that are trusted here " * 3 if i % 2 else "rude rude bad words all over " * 3, "en") for i in range(60)]
    rows = spark.createDataFrame([(*d, *"abcdef") for d in docs], "doc_id long, text string, lang string, gain string, log10_trusted string, log10_other string, peak string, of string, sm string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    carry = ("gain", "log10_trusted", "log10_other", "of", "sm", "text")
    got = Q.classify(rows, labels, carry).collect()
    assert sorted((r.text, r.gain, r.log10_trusted, r.log10_other, r.of, r.sm) for r in got) == sorted((t, "a", "b", "c", "e", "f") for _, t, _ in docs)
    assert {"doc_id", "lang"}.isdisjoint(got[0].asDict())


@pytest.mark.parametrize("frequent", [0, 5, 40])
def test_probabilities_by_join(spark, monkeypatch, frequent):
    """Pairs of words that are not sent to the tasks count as well."""
    monkeypatch.setattr(Q, "FREQUENT", frequent)
    random.seed(5)
    texts = [" ".join(random.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=random.randint(0, 30))) for _ in range(40)]
    model = Q.train(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), 2)
    assert model.rare is not None
    plain, asked = Plain(texts, 2), ["a b a z", "h h h", "", None, *texts[:5], texts[0]]
    rows = spark.createDataFrame([(i % 8, t) for i, t in enumerate(asked)], "doc_id long, text string")
    got = Q.score(rows, model, model, ("doc_id", "text"), 2).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i % 8, t or "") for i, t in enumerate(asked))
    for r in got:
        assert r.log10_trusted == pytest.approx(sum(math.log10(plain.p(g)) for g in plain.grams(r.text, 2)), rel=1e-5)


def test_models_learn_from_all_labelled_documents(spark, monkeypatch):
    learned, train = [], Q.train
    monkeypatch.setattr(Q, "train", lambda docs, *more: learned.append(docs.count()) or train(docs, *more))
    docs = spark.range(6000).selectExpr("id AS doc_id", "concat('w', id % 97, ' v', id % 89) AS text", "'en' AS lang")
    labels = spark.range(6000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic")
    assert Q.classify(docs, labels).count() == 6000
    roll = F.pmod(F.xxhash64("doc_id"), F.lit(1000)) < int(1000 * Q.UNSEEN)
    assert learned == [labels.where((F.col("quality") == 1) & ~roll).count(), 3000] and min(learned) > 2000


def test_words_alone(spark):
    random.seed(6)
    texts = [" ".join(random.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=random.randint(0, 30))) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole, words = Q.train(docs, 2), Q.train(docs, 2, 1)
    grams = next(Q._grams(Q.pa.array(texts), 1))[3]
    assert len(words.shares) == 1 and words.unknown == whole.unknown
    assert words.probability(grams, []).tolist() == whole.probability(grams, []).tolist()


@pytest.mark.parametrize("frequent", [0, 40, 10_000])
def test_slices_give_the_whole(spark, monkeypatch, frequent):
    """Counting and joining slice by slice gives the probabilities of the whole model, of copies too, and leaves no table behind that is not read."""
    from digestry.session import scratch_root

    folder = scratch_root(spark) + "/digestry"
    monkeypatch.setattr(Q, "FREQUENT", frequent)
    monkeypatch.setattr(Q, "SLICE_BYTES", 100)
    random.seed(5)
    texts = [" ".join(random.choices("abcdefgh", weights=[9, 7, 5, 3, 2, 1, 1, 1], k=random.randint(0, 30))) for _ in range(60)]
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    lessons = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert Q._slices(lessons) == Q.SLICES
    model = Q.train(lessons, 2)
    made = {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before}
    assert made == ({"grams"} if frequent < 100 else set())
    assert (model.rare is None) == (frequent == 10_000)
    plain, asked = Plain(texts, 2), ["a b a z", "h h h", "", None, *texts[:5], texts[0], texts[0], texts[1].upper()]
    rows = spark.createDataFrame([(i % 8, t) for i, t in enumerate(asked)], "doc_id long, text string").repartition(3)
    got = Q.score(rows, model, model, ("doc_id", "text"), 2).collect()
    assert sorted((r.doc_id, r.text or "") for r in got) == sorted((i % 8, t or "") for i, t in enumerate(asked))
    for r in got:
        assert r.log10_trusted == pytest.approx(sum(math.log10(plain.p(g)) for g in plain.grams(r.text, 2)), rel=1e-5)


def test_shuffled_rows_go_with_their_query(spark, monkeypatch):
    """The setting holds while the models learn, and the session gets its own back."""
    setting, seen, train = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", [], Q.train
    before = spark.conf.get(setting, None)
    monkeypatch.setattr(Q, "train", lambda *given: seen.append(spark.conf.get(setting)) or train(*given))
    docs, labels = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic boolean")
    assert Q.classify(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == len(docs)
    assert seen == ["true", "true"] and spark.conf.get(setting, None) == before


def test_only_chosen_texts_are_shuffled(spark):
    """Which documents are labelled is told before texts are shuffled, by a sketch of bounded size; the join leaves exactly those."""
    docs = spark.range(4000).selectExpr("CASE WHEN id % 100 = 7 THEN null ELSE id END AS doc_id", "concat('text ', id) AS text")
    chosen = spark.range(0, 4000, 40).selectExpr("id AS doc_id", "id % 80 = 0 AS good")
    found = Q._lessons(docs.union(docs), chosen)
    assert sorted(found.select("doc_id", "text", "good").collect()) == sorted((i, f"text {i}", i % 80 == 0) for i in range(0, 4000, 40) for _ in range(2))
    keys = spark.range(4000).select(F.xxhash64("id").alias("gram"))
    bits = Q._sketch(chosen.select(F.xxhash64("doc_id").alias("gram")))
    marked = Q._marked(bits, keys.toArrow().column(0).to_numpy().view("uint64"))
    assert marked[::40].all() and marked.sum() < 110


def test_sketches_hold_one_round(spark, monkeypatch):
    """Each round's sketch has only the pairs of words of that round."""
    marked, sketch = [], Q._sketch
    monkeypatch.setattr(Q, "FREQUENT", 0)
    monkeypatch.setattr(Q, "SLICE_BYTES", 100)
    monkeypatch.setattr(Q, "_sketch", lambda grams: marked.append(grams.count()) or sketch(grams))
    random.seed(5)
    texts = [" ".join(random.choices("abcdefgh", k=20)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    model = Q.train(docs, 2)
    pairs = sum(x.count() for x in model.rare)
    Q.score(docs, model, model, ("doc_id",), 2).collect()
    assert len(marked) == Q.SLICES // Q.TOGETHER and sum(marked) == pairs and max(marked) < pairs


def test_batches_of_texts_are_small(spark, monkeypatch):
    """The setting holds while the models learn, and the session gets its own back."""
    setting, seen, train = "spark.sql.execution.arrow.maxRecordsPerBatch", [], Q.train
    before = spark.conf.get(setting, None)
    monkeypatch.setattr(Q, "train", lambda *given: seen.append(int(spark.conf.get(setting))) or train(*given))
    docs, labels = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic boolean")
    assert Q.classify(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == len(docs)
    assert seen and max(seen) <= 2048 and spark.conf.get(setting, None) == before


def test_driver_holds_one_model_at_a_time(spark, monkeypatch):
    """While the second model learns, the driver has sent the first and let go of it."""
    made, alive, train = [], [], Q.train

    def watched(*given):
        alive.append(sum(x() is not None for x in made))
        model = train(*given)
        made.extend(weakref.ref(x) for x in (model, *model.shares, *model.rests))
        return model

    monkeypatch.setattr(Q, "train", watched)
    docs, labels = corpus()
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, toxic boolean")
    assert Q.classify(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == len(docs)
    assert alive == [0, 0] and not any(x() for x in made)


def test_sent_models_are_whole(spark):
    """What tasks read has the tables that the driver had, in order, each in bytes of its own."""
    model = Q.train(spark.createDataFrame([(1, "a b c a b d"), (2, "b a d")], "doc_id long, text string"), 2)
    read = pickle.loads(pickle.dumps(Q._ModelByValue(model)))
    assert read.unknown == model.unknown and read.rare is None and [list(x) for x in read.discounts] == [list(x) for x in model.discounts]
    for a, b in zip([*read.shares, *read.rests], [*model.shares, *model.rests], strict=True):
        assert a.get(b.keys, 0).tolist() == b.values.tolist()
