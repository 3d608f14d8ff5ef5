"""Ranks, caps and the whole curation against plain loops."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from plain import displaced

from digestry.operators.ranking import passing_with_fallback, ranked
from digestry.operators.selection import select_top
from digestry.plans.curate import funnel, select_unique
from digestry.settings import Settings

SCHEMA = "brief_id bigint, ord bigint, quality_score bigint, title string, domain string, channel string"


def plain_dedup(rows):
    found = displaced([(i, row[3]) for i, row in enumerate(rows)])
    return [row for i, row in enumerate(rows) if found[i] is None]


def plain_select(rows, s):
    out, domains, channels = [], Counter(), Counter()
    for row in rows:
        domain, channel = row[4] or "other", row[5] or ""
        if len(out) < s.total and domains[domain] < s.per_domain and channels[channel] < s.per_channel:
            out.append(row)
            domains[domain] += 1
            channels[channel] += 1
    return out


def plain_curate(rows, s):
    out = []
    for brief in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == brief), key=lambda r: (-r[2], r[1]))
        passing = [r for r in mine if r[2] >= s.threshold] or [r for r in mine if r[2] >= s.fallback_threshold]
        out += [(r[0], r[1], i) for i, r in enumerate(plain_select(plain_dedup(passing), s), 1)]
    return sorted(out)


def random_rows(seed, briefs, size, domains, channels, vocabulary, low=10, high=60):
    rnd = random.Random(seed)
    return [(b, i, rnd.randint(low, high if b % 3 else 39),
             " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(rnd.randint(1, 4))),
             rnd.choice([None, *(f"d{k}" for k in range(domains))]), rnd.choice([None, *(f"c{k}" for k in range(channels))]))
            for b in range(briefs) for i in range(size)]


@pytest.mark.parametrize("lines, picks", [
    ("Ax Ax Bx By", [1, 2, 4]),
    ("Ax Ax Ay Az Bz Bz", [1, 2, 3, 5, 6]),
    ("Aa Bb Cc Dd Ee Ff Gg Hh Ii", [1, 2, 3, 4, 5, 6, 7, 8]),
])
def test_caps_on_fixture_rows(spark, lines, picks):
    rows = [(1, i, 100 - i, "t", e[0], e[1]) for i, e in enumerate(lines.split(), 1)]
    out = select_top(spark.createDataFrame(rows, SCHEMA), Settings()).orderBy("pick").collect()
    assert [r.ord for r in out] == picks


@pytest.mark.parametrize("caps", [(3, 2, 8), (1, 1, 5), (2, 5, 7), (4, 3, 30), (5, 1, 4)])
def test_caps_equal_the_walk(spark, caps):
    s = Settings(per_domain=caps[0], per_channel=caps[1], total=caps[2])
    rows = random_rows(7, 60, 50, 4, 6, 5) + [(900 + r[0], *r[1:]) for r in random_rows(8, 20, 120, 30, 3, 5)]
    got = sorted((r.brief_id, r.ord, r.pick) for r in select_top(spark.createDataFrame(rows, SCHEMA), s).collect())
    expected = []
    for brief in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == brief), key=lambda r: (-r[2], r[1]))
        expected += [(r[0], r[1], i) for i, r in enumerate(plain_select(mine, s), 1)]
    assert got == sorted(expected)


@pytest.mark.parametrize("limits", [{}, dict(head_rows=3), dict(head_rows=3, fold_rows=8)])
def test_curation_equals_the_loop(spark, limits):
    s = Settings(**limits)
    rows = random_rows(11, 12, 60, 2, 4, 30) + [(50, i, 5, "x", "d", "c") for i in range(4)]
    got = select_unique(spark.createDataFrame(rows, SCHEMA), s).collect()
    assert sorted((r.brief_id, r.ord, r.pick) for r in got) == plain_curate(rows, s)


def test_full_domains_close_a_selection(spark, monkeypatch):
    """Two domains give six picks at most: no need to look at all titles of the briefing."""
    from digestry.plans import curate as plan
    monkeypatch.setattr(plan, "drop_similar_titles", lambda *a, **k: pytest.fail("took the complete path"))
    rows = [(b, i, 90 - i % 50, f"a{i} b{i}", f"d{i % 2}", f"c{i}") for b in (1, 2) for i in range(300)]
    got = select_unique(spark.createDataFrame(rows, SCHEMA), Settings()).collect()
    assert sorted((r.brief_id, r.ord, r.pick) for r in got) == plain_curate(rows, Settings())


def test_ranks_in_pieces_equal_plain_ranks(spark):
    rnd = random.Random(3)
    rows = [(b, o * 1000 + b, rnd.randint(0, 6), "", "", "") for b, n in ((1, 700), (2, 30), (3, 1)) for o in range(n)]
    out = ranked(spark.createDataFrame(rows, SCHEMA), Settings(rank_group_rows=40)).collect()
    got = {(r.brief_id, r.ord): r["rank"] for r in out}
    expected = {}
    for brief in (1, 2, 3):
        mine = sorted((r for r in rows if r[0] == brief), key=lambda r: (-r[2], r[1]))
        expected.update({(r[0], r[1]): i for i, r in enumerate(mine, 1)})
    assert got == expected and len(out) == len(rows)


def test_fallback_threshold(spark):
    rows = [(1, 1, 45, "", "", ""), (1, 2, 39, "", "", ""), (2, 1, 39, "", "", ""), (2, 2, 19, "", "", "")]
    out = passing_with_fallback(spark.createDataFrame(rows, SCHEMA), Settings()).collect()
    assert sorted((r.brief_id, r.ord, r.threshold_used) for r in out) == [(1, 1, 40), (2, 1, 20)]


def test_funnel(spark):
    rows = [(1, 1, 50, "a b c", "d", "c"), (1, 2, 50, "a b c", "d", "c"), (1, 3, 50, "x", "d", "c"),
            (1, 4, 50, "y", "d", "c"), (1, 5, 10, "z", "d", "c"), (2, 1, 10, "z", "d", "c")]
    out = funnel(spark.createDataFrame(rows, SCHEMA), Settings()).orderBy("brief_id").collect()
    assert [tuple(r) for r in out] == [(1, 5, 4, 3, 2), (2, 1, 0, 0, 0)]


def test_group_limits_apply_before_the_shuffle(spark):
    """Only a few rows per group may be shuffled, however many rows a group has."""
    from digestry.sources.videos import first_per_id
    df = spark.range(1000).select((F.col("id") % 3).alias("item_id"), F.col("id").alias("ord"))
    plan = first_per_id(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
    rows = spark.createDataFrame(random_rows(1, 2, 5, 2, 2, 5), SCHEMA)
    plan = select_top(rows, Settings())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") == 4
