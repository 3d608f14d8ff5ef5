"""Greedy removal of similar titles against a plain loop, on both physical paths."""

import random

import pytest
from pyspark.sql import functions as F

from plain import displaced

from digestry import session
from digestry.operators import titles
from digestry.operators.titles import drop_similar_titles, match_titles, title_matches
from digestry.settings import Settings

SCHEMA = "brief_id bigint, ord bigint, quality_score bigint, title string"


def plain_loop(rows):
    """{(brief, ord): ordinal of the first kept similar title or None}"""
    out = {}
    for brief in {r[0] for r in rows}:
        ranked = sorted((r for r in rows if r[0] == brief), key=lambda r: (-r[2], r[1]))
        out |= {(brief, k): of for k, of in displaced([(r[1], r[3]) for r in ranked]).items()}
    return out


def spark_result(spark, rows, settings):
    found = match_titles(spark.createDataFrame(rows, SCHEMA), settings)
    return {(r.brief_id, r.ord): r.duplicate_of for r in found.collect()}


@pytest.mark.parametrize("titles, kept", [
    (["a b c", "a b z", "z q", ""], [1, 3, 4]),
    (["a b c", "b c d", "c d e"], [1, 3]),
    (["AI", "AI chip news today"], [1]),
    (["café GPU", "CAFÉ gpu"], [1]),
    (["机器人大会", "机器人大会 2026"], [1]),
])
@pytest.mark.parametrize("fold_rows", [256, 1])
def test_edge_titles(spark, titles, kept, fold_rows):
    rows = [(1, i, 50, t) for i, t in enumerate(titles, 1)]
    out = drop_similar_titles(spark.createDataFrame(rows, SCHEMA), Settings(fold_rows=fold_rows))
    assert sorted(r.ord for r in out.collect()) == kept


def random_rows(seed, briefs, per_brief, vocabulary):
    rnd = random.Random(seed)
    rows = []
    for b in range(briefs):
        for i in range(per_brief):
            n = rnd.choice([0, 1, 2, 3, 3, 4, 5])
            rows.append((b, i, rnd.randint(40, 44), " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))))
    return rows


def test_fold_equals_loop(spark):
    rows = random_rows(1, 40, 60, 40)
    assert spark_result(spark, rows, Settings()) == plain_loop(rows)


@pytest.mark.parametrize("limits", [
    dict(fold_rows=12),                                       # several stretches
    dict(fold_rows=12, pairs_per_task=5),                      # rounds
    dict(fold_rows=16, pair_budget=500, pairs_per_title=2),                       # stretches cut down
    dict(fold_rows=12, rank_group_rows=16),                    # ranks in pieces
])
def test_large_path_equals_loop(spark, limits):
    rows = random_rows(2, 6, 120, 60) + random_rows(3, 1, 3, 9)
    assert spark_result(spark, rows, Settings(**limits)) == plain_loop(rows)


def test_one_briefing_full_of_near_copies(spark):
    rows = [(1, i, 40, f"breaking storm report number {i} for the coast") for i in range(3000)]
    rows += [(1, 3000 + i, 60, f"x{i} y{i} z{i}") for i in range(600)]
    rows += [(1, 5000 + i, 50, "the very same headline") for i in range(3000)]
    got = spark_result(spark, rows, Settings())
    kept = {k[1] for k, of in got.items() if of is None}
    assert kept == {0, 5000} | set(range(3000, 3600))
    assert all(got[1, i] == 0 for i in range(1, 3000)) and all(got[1, 5000 + i] == 5000 for i in range(1, 3000))


def test_long_chain(spark):
    rows = [(1, i, 50, f"c{i} c{i + 1} c{i + 2}") for i in range(40)]
    for limits in (dict(fold_rows=12), dict(fold_rows=12, pairs_per_task=20)):
        assert spark_result(spark, rows, Settings(**limits)) == plain_loop(rows)


def test_matches_name_the_first_kept_title(spark):
    rows = [(1, 1, 50, "a b c"), (1, 2, 50, "b c d"), (1, 3, 50, "c d e"), (1, 4, 50, "a b c d e")]
    out = title_matches(spark.createDataFrame(rows, SCHEMA), Settings()).orderBy("ord").collect()
    assert [(r.ord, r.duplicate_of, r.shared_words, r.smaller_words) for r in out] == [(2, 1, 2, 3), (4, 1, 3, 3)]


def test_tables_of_words_do_not_pass_the_driver(spark, monkeypatch):
    plans = {}

    def stored(rows, label):
        plans.setdefault(label, []).append(rows._jdf.queryExecution().executedPlan().toString())
        return session.settle(rows, label)

    monkeypatch.setattr(titles, "settle", stored)
    rows = random_rows(11, 1, 400, 80)
    assert spark_result(spark, rows, Settings(fold_rows=16)) == plain_loop(rows)
    joined = [plan for label in ("title-hits", "title-rest", "pairs", "title-kept") for plan in plans[label]]
    assert len(joined) > 3 and not [plan for plan in joined if "BroadcastExchange" in plan]


def test_merged_rounds_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(titles, "MOST_PARTS", 1)
    rows = random_rows(12, 2, 90, 60)
    assert spark_result(spark, rows, Settings(fold_rows=16, pair_budget=1, pairs_per_title=0, pairs_per_task=20)) == plain_loop(rows)
