import random
import re

import pytest
from pyspark.sql import functions as F

from digestry.llm import urls


def plain(rules, host, path):
    """Longest pattern that fits, the first of equals, by regular expressions."""
    turned = lambda glob, any_: "".join(any_ + "*" if c == "*" else any_ if c == "?" else re.escape(c) for c in glob)
    best = None
    for i, r in enumerate(rules):
        h, slash, p = r.pattern.partition("/")
        fits = re.fullmatch("(?s:.*)\\." + turned(h, "(?s:.)"), "." + host) and re.match(turned(slash + p, "(?s:.)"), path)
        if fits and (best is None or len(r.pattern) > len(rules[best].pattern)):
            best = i
    return -1 if best is None else best


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_expressions(seed):
    import numpy as np

    random.seed(seed)
    pick = lambda chars, n: "".join(random.choices(chars, k=random.randint(0, n)))
    rules = [urls.Rule((pick("ab.*", 4) or "a") + "/" + pick("ab/*", 4), "block") for _ in range(40)]
    pairs = [(pick("ab.", 6), random.choice(["", "/"]) + pick("ab/", 7)) for _ in range(300)]
    automaton = urls.Automaton(rules)
    assert automaton.words > 3
    as_symbols = lambda h, p: np.array([*("." + h).encode(), urls.BREAK, *p.encode()], np.int64)
    assert automaton.winners([as_symbols(*x) for x in pairs]).tolist() == [plain(rules, *x) for x in pairs]


def test_question_mark_and_no_rules():
    import numpy as np

    automaton = urls.Automaton([urls.Rule("a?c.org/x?z", "block")])
    as_symbols = lambda h, p: np.array([*("." + h).encode(), urls.BREAK, *p.encode()], np.int64)
    assert automaton.winners([as_symbols("abc.org", "/xyz1"), as_symbols("w.abc.org", "/xyz"), as_symbols("ac.org", "/xyz"), as_symbols("abc.org", "/xz")]).tolist() == [0, 0, -1, -1]
    assert urls.Automaton([]).winners([as_symbols("a", "")]).tolist() == [-1]


def test_rows(spark):
    rules = [urls.Rule("org/", "allow"), urls.Rule("example.org/es/", "block"), urls.Rule("com/de/", "block"), urls.Rule("org/", "block")]
    rows = [(1, "https://A.Example.ORG/es/x?q#f", "org/", "example.org/es/", "block"), (2, "http://example.org", None, None, "allow"),
            (3, "http://example.org?x=/es/", None, None, "allow"), (4, "no scheme.org/es/", None, None, "allow"), (5, None, None, None, "allow"), (6, "", None, None, "allow"),
            (7, "http://notexample.org/es/", "", "org/", "allow"), (8, "http://x.com/DE/", "", None, "allow"), (9, "http://x.com/de/" + "y" * 20000, "", "com/de/", "block"),
            (10, "a://b://c.org/p", "", None, "allow"), (7, "http://notexample.org/es/", "", "org/", "allow"), (11, "http://évil.org/x", "", "org/", "allow"),
            (12, "http://evil.com/x.org/", "", None, "allow")]
    pages = spark.createDataFrame([(i, u, 5, "clash") for i, u, *_ in rows], "page_id long, url string, host int, verdict string")
    got = urls.filter_urls(pages, rules)
    assert got.columns == ["page_id", "url", "host", "path", "rule", "verdict"]
    assert sorted((r.page_id, str(r.rule), r.verdict) for r in got.collect()) == sorted((i, str(rule), says) for i, _, _, rule, says in rows)
    one = got.where("page_id = 1").first()
    assert (one.host, one.path) == ("a.example.org", "/es/x")
    assert got.where(F.col("page_id").isin(4, 5, 6)).agg(F.max("host"), F.max("path")).first()[:] == ("", "")
    assert urls.filter_urls(spark.createDataFrame([], "url string"), rules).collect() == []


def test_capitals_in_the_host_of_a_rule(spark):
    pages = spark.createDataFrame([("http://www.Example.ORG/A",), ("http://example.org/a",)], "url string")
    got = {r.url: r.rule for r in urls.filter_urls(pages, [urls.Rule("eXample.org/A", "block")]).collect()}
    assert got == {"http://www.Example.ORG/A": "eXample.org/A", "http://example.org/a": None}
