"""Models over the components of the score."""

import random
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from digestry import Settings
from digestry.operators import learning

NOW = datetime(2026, 4, 24, 8, tzinfo=timezone.utc)
S = Settings(as_of=NOW, whitelist=("trusted",), spam_keywords=("buy",))
ITEMS = ("item_id string, kind string, channel string, title string, description string, published_at timestamp, views bigint, likes bigint, "
         "comments bigint, duration string, authority string")


def made(n, seed=1):
    rng = random.Random(seed)
    return [(f"i{i}", "YouTube", rng.choice(["trusted", "other"]), f"t{i}", rng.choice(["", "buy now "]), NOW - timedelta(hours=rng.choice([1, 8, 20, 50])), 0,
             rng.choice([0, 200, 2000, 9000]), 0, rng.choice(["PT1M", "PT6M", "PT20M"]), None) for i in range(n)]


def features(spark, rows):
    got = learning.with_features(spark.createDataFrame(rows, ITEMS), S, ["item_id"]).collect()
    return {r.item_id: np.array([r[f] for f in learning.FEATURES]) for r in got}


def auc(scores, labels):
    """Part of pairs of unlike labels in the right order."""
    pairs = [(a, b) for a, x in zip(scores, labels) for b, y in zip(scores, labels) if x > y]
    return sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)


def test_quality_from_labels(spark):
    rng, rows = random.Random(2), made(400)
    x = features(spark, rows)
    label = {i: int(v[0] + v[2] - v[5] + rng.gauss(0, 6) > 20) for i, v in x.items()}
    items = spark.createDataFrame(rows, ITEMS)
    labels = spark.createDataFrame([*label.items(), ("unknown", 1), ("i0", None)], "item_id string, label int")
    first, again = (learning.learn_quality(items.repartition(n), labels, S) for n in (3, 7))
    scored = {r.item_id: r.probability for r in first.score(items, S).collect()}
    assert scored.keys() == label.keys() and all(0 < p < 1 for p in scored.values()) and first.labels == 400
    unseen = [r.item_id for r in items.where(learning.held_out(F.col("item_id"))).collect()]
    assert 40 < len(unseen) < 120
    assert first.auc == pytest.approx(auc([scored[i] for i in unseen], [label[i] for i in unseen]), abs=1e-6) and first.auc > 0.8
    assert first.auc == pytest.approx(again.auc, abs=1e-6)
    # Unseen labels do not change the model.
    other = spark.createDataFrame([(i, 1 - y if i in unseen else y) for i, y in label.items()], "item_id string, label int")
    turned = learning.learn_quality(items.repartition(3), other, S)
    assert turned.auc == pytest.approx(1 - first.auc, abs=1e-6)
    plan = first.score(items, S)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_embeddings_as_features(spark):
    rng, rows = random.Random(3), made(200)
    vector = {r[0]: [rng.gauss(0, 1), rng.gauss(0, 1)] for r in rows}
    label = {i: int(v[1] > 0) for i, v in vector.items()}
    del vector["i5"], vector["i6"]
    vector["i6"] = [1.0]
    held = spark.createDataFrame(list(vector.items()), "item_id string, v array<double>")
    items = spark.createDataFrame(rows, ITEMS).join(held, "item_id", "left")
    model = learning.learn_quality(items, spark.createDataFrame(list(label.items()), "item_id string, label int"), S, vector="v")
    assert model.auc > 0.95 and model.score(items, S, vector="v").count() == 200


def test_too_few_labels(spark):
    items = spark.createDataFrame(made(80), ITEMS)
    few = spark.createDataFrame([(f"i{i}", i % 2) for i in range(49)], "item_id string, label int")
    same = spark.createDataFrame([(f"i{i}", 1) for i in range(80)], "item_id string, label int")
    for labels in (few, same, few.limit(0)):
        with pytest.raises(learning.TooFewLabels):
            learning.learn_quality(items, labels, S)


def plain_weights(rows, steps=60):
    """Newton's method for the mean logistic loss with half the squared length as penalty."""
    w, r = np.zeros(rows.shape[1]), learning.REGULAR
    for _ in range(steps):
        p = 1 / (1 + np.exp(-rows @ w))
        gradient = -(rows * (1 - p)[:, None]).mean(axis=0) + r * w
        curve = (rows * (p * (1 - p))[:, None]).T @ rows / len(rows) + r * np.eye(len(w))
        w = w - np.linalg.solve(curve, gradient)
    return w


def reactions_of(x, readers, seed=4):
    """Readers who like what is long and new, and do not care for the rest."""
    rng = random.Random(seed)
    rows = [(u, i, "like" if v[1] + v[4] + rng.gauss(0, 3) > 14 else "dislike") for u in range(readers) for i, v in x.items() if rng.random() < 0.5]
    return [(n, *r) for n, r in enumerate(rows)]


EVENTS = "event_ord bigint, user_id bigint, item_id string, reaction string"


def test_ranking_from_reactions(spark):
    rows = made(120, 5)
    x = features(spark, rows)
    events = reactions_of(x, 4)
    df = spark.createDataFrame([(-1, *e[1:3], "like") for e in events[:50]] + events, EVENTS)  # earlier reactions do not count
    model = learning.learn_ranking(df, spark.createDataFrame(rows, ITEMS), S)
    pairs = [tuple(p) for p in learning.preference_pairs(df.where("event_ord >= 0").withColumn("_unseen", learning.held_out(F.col("user_id"), F.col("item_id"))),
                                                         ["user_id", "_unseen"]).select("_unseen", "liked", "disliked").collect()]
    seen = np.array([x[a] - x[b] for unseen, a, b in pairs if not unseen])
    unseen = np.array([x[a] - x[b] for unseen, a, b in pairs if unseen])
    assert (model.pairs, model.unseen_pairs) == (len(seen), len(unseen))
    expected = plain_weights(seen)
    assert np.allclose(list(model.weights.values()), expected, atol=2e-3)
    gain = unseen @ np.array(list(model.weights.values()))
    assert model.right == pytest.approx(np.mean((gain > 0) + (gain == 0) / 2)) and model.right > 0.85 > model.right_additive
    scored = {r.item_id: r.learned_score for r in model.score(spark.createDataFrame(rows, ITEMS), S).collect()}
    assert all(scored[i] == pytest.approx(v @ np.array(list(model.weights.values()))) for i, v in x.items())


def test_pairs_follow_the_number_of_reactions(spark):
    """Never all pairs of a reader, yet nearly all items meet someone; and only the reader's own."""
    rows = [(u, f"{u}-{i}", "like" if i % 3 else "dislike") for u, n in ((1, 3000), (2, 30), (3, 1)) for i in range(n)] + [(4, f"4-{i}", "like") for i in range(50)]
    df = spark.createDataFrame(rows, "user_id bigint, item_id string, reaction string")
    pairs = learning.preference_pairs(df).collect()
    reaction = {i: r for _, i, r in rows}
    assert all(p.liked.split("-")[0] == p.disliked.split("-")[0] == str(p.user_id) and reaction[p.liked] == "like" != reaction[p.disliked] for p in pairs)
    one = [p for p in pairs if p.user_id == 1]
    assert 0.8 * 2000 * learning.PARTNERS < len(one) < 1.2 * 2000 * learning.PARTNERS
    assert len({p.liked for p in one}) > 0.9 * 2000 and len({p.disliked for p in one}) > 0.9 * 1000
    assert {p.user_id for p in pairs} == {1, 2}


def test_too_few_pairs(spark):
    items = spark.createDataFrame(made(5), ITEMS)
    with pytest.raises(learning.TooFewLabels):
        learning.learn_ranking(spark.createDataFrame([(1, 1, "i1", "like"), (2, 1, "i2", "no")], EVENTS), items, S)
    with pytest.raises(learning.TooFewLabels):
        learning.learn_ranking(spark.createDataFrame([], EVENTS), items, S)
