import random
import re

import pytest
from pyspark.sql import functions as F

from digestry.llm import rules

SCHEMA = "doc_id long, text string, source string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_facts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    seen, again = {}, set()
    for i, x in enumerate(windows):
        seen.setdefault(x, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            again.update(j for i in at for j in range(i, i + 8))
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(again)}


def plain_failed(f):
    checks = {"few_words": f["n_words"] < 20, "repeats": 100 * f["n_repeat_words"] > 30 * f["n_words"], "symbols": 10 * f["n_symbols"] > f["n_words"],
              "duplicate_lines": 10 * f["n_dup_lines"] > 3 * f["n_lines"],
              "word_length": f["word_chars"] < 3 * f["n_words"] or f["word_chars"] > 10 * f["n_words"]}
    return [r for r, bad in checks.items() if bad]


def plain(rows):
    """{row: (failed, blocked, failed and watched, kept)}, from the rules as they are written."""
    facts = [plain_facts(r[1]) for r in rows]
    failed = [plain_failed(f) for f in facts]
    hosts = {}
    for r, bad in zip(rows, failed):
        hosts.setdefault(r[2], []).append(bad)
    blocked, watched = set(), {h: set() for h in hosts}
    n, k = len(rows), len(hosts)
    for rule in rules.RULES:
        fails = {h: sum(rule in b for b in bads) for h, bads in hosts.items()}
        p = sum(fails.values()) / n
        rate = {h: fails[h] / len(hosts[h]) for h in hosts}
        strength = 1.0
        if k > 1 and n > k:
            between = sum(len(hosts[h]) * (rate[h] - p) ** 2 for h in hosts) / (k - 1)
            inside = sum(len(hosts[h]) * rate[h] * (1 - rate[h]) for h in hosts) / (n - k)
            usual = (n - sum(len(b) ** 2 for b in hosts.values()) / n) / (k - 1)
            whole = between + (usual - 1) * inside
            rho = (between - inside) / whole if whole > 0 else 0
            strength = 1e6 if rho <= 1e-12 else min(max((1 - rho) / rho, 1), 1e6)
        for h in hosts:
            shrunk = (fails[h] + p * strength) / (len(hosts[h]) + strength)
            if shrunk > 0.5:
                blocked.add(h)
            if shrunk > max(0.2, 2 * p):
                watched[h].add(rule)
    out = []
    for r, f, bad in zip(rows, facts, failed):
        base = "few_words" in bad or "repeats" in bad
        held = [x for x in bad if x in watched[r[2]]]
        out.append((r[0], tuple(f.values()), bad, base, r[2] in blocked, held, not base and r[2] not in blocked and not held))
    return sorted(out, key=repr)


def found(frame):
    return sorted(((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words), r.failed, r.base_failed,
                    r.host_blocked, r.host_watched, r.kept) for r in frame.collect()), key=repr)


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = ["word", "été", "数据", "a", "lengthy", "😀", "x#y", "<tag>"]
    prose = lambda n: " ".join(rng.choice(["some", "plain", "words", "of", "prose", "and", "more", str(rng.randrange(10**6))]) for _ in range(n))
    rows = []
    for i in range(300):
        host = rng.choice(["hot"] * 6 + ["junk", "odd", "small%d" % rng.randrange(30), None])
        if host == "junk" and rng.random() < 0.9:
            text = rng.choice(["too short", "again and again. " * 30, "# | % " * 30])
        elif host == "odd" and rng.random() < 0.4:
            text = "\n".join(["menu item"] * 12 + [prose(30)])
        else:
            text = rng.choice([prose(rng.randrange(1, 60)), " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60))), prose(25) + "\r\n\x0b " + prose(9)])
        rows.append((i, text, host))
    passage = prose(9)
    return rows + [(None, passage + "\n" + passage, "hot"), (7, None, None), (7, "", "hot"), (7, "", "hot"), (8, " \n\t\n", "ünï"), (9, "x" * 400_000, "hot"),
                   (10, "a b c d e f g h " * 5000, "hot"), (11, "a b c d e f g h", "hot"), (12, "a b c d e f g h a b c d e f g h", "hot")]


def test_against_plain(spark):
    rows = corpus()
    expected = plain(rows)
    assert found(rules.apply_rules(spark.createDataFrame(rows, SCHEMA).repartition(7))) == expected
    assert any(r[4] for r in expected) and any(r[5] for r in expected) and any(r[6] for r in expected)
    # The other way of joining verdicts gives the same.
    assert found(rules.apply_rules(spark.createDataFrame(rows, SCHEMA), sent_hosts=0)) == expected


def test_single_host_and_single_documents(spark):
    for rows in ([(1, "a b", "x")], [(i, "word " * 30, "x") for i in range(5)], [(i, f"some plain words {i} " * (i % 2 + 1) * 7, f"h{i}") for i in range(6)]):
        assert found(rules.apply_rules(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_empty_table_and_clashing_names(spark):
    assert found(rules.apply_rules(spark.createDataFrame([], SCHEMA))) == []
    rows = corpus(9)[:40]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("host", "n", "kept", "failed", "blocked", "salt", "n_words", "w", "x"):
        docs = docs.withColumn(name, F.lit("x"))
    assert found(rules.apply_rules(docs)) == plain(rows)


@pytest.mark.parametrize("sizes, fails, weak", [((50, 50, 50), (5, 5, 5), False), ((50, 50, 50), (0, 5, 45), True)])
def test_prior_follows_the_spread(sizes, fails, weak):
    within = sum(f * (n - f) / n for n, f in zip(sizes, fails))
    strength = rules.prior_strength(sum(sizes), len(sizes), sum(n * n for n in sizes), sum(fails), within)
    assert (strength < 5) == weak and (strength == rules.MOST) != weak


def test_plan_has_no_python(spark):
    plan = rules.apply_rules(spark.createDataFrame(corpus()[:5], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
