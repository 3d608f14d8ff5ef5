import random

import pytest
from helpers import near_duplicates

from digestry.llm import graph, minhash

SCHEMA = "doc_id long, text string, component_id string, kept int"


def texts():
    random.seed(5)
    word = lambda: "w%d" % random.randint(0, 5000)
    docs = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        docs.append(" ".join(base))
        for k in range(25):
            copy = list(base)
            for _ in range(k // 6):
                copy[random.randrange(len(copy))] = word()
            docs.append(" ".join(copy))
    docs += ["", None, "a b", "a  B", "a b c", " \n", "one two three four five", "One two three four FIVE"] + [docs[0]] * 5
    docs += [" ".join(word() for _ in range(random.randint(1, 300))) for _ in range(40)]
    random.shuffle(docs)
    return docs


@pytest.mark.parametrize("percent, few", [(85, 32), (85, 1), (80, 3)])
def test_against_all_pairs(spark, monkeypatch, percent, few):
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "BLOCK", 700)
    docs = list(enumerate(texts()))
    rows = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(rows, percent).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in near_duplicates(docs, percent).items()}


def test_odd_rows(spark):
    same = "the very same text of some words"
    rows = [(None, same), (None, None), (7, same), (7, same), (9, same), (9, "another text of the same number here"), (3, "another text of the same number here"), (5, None)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {
        (None, None, True), (7, 7, True), (9, 7, False), (9, 3, False), (3, 3, True), (5, 5, True)}
    empty = minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.collect() == [] and empty.columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 160)] + [(5, 5), (300, 301), (301, 300)]
    random.seed(1)
    links = [(a, b) if random.random() < 0.5 else (b, a) for a, b in links]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    expected = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {300: 300, 301: 300}
    assert got == expected


def test_blocks_without_members(spark):
    from pyspark.sql import functions as F

    from digestry.llm import minhash

    docs = spark.createDataFrame([(i, "one two three four five six seven eight nine") for i in range(3)], "doc_id long, text string")
    classes = minhash.signatures(docs).withColumnRenamed("doc_id", "node")
    crowded = classes.select(F.col("bands")[0].alias("bucket"), F.col("node").alias("u"), F.col("node").alias("c"), F.lit(8 * minhash.BLOCK).alias("weight"))
    links = {tuple(r) for r in minhash._in_blocks(crowded, classes, docs, 85, 5).collect()}
    assert len({x for pair in links for x in pair}) == 3


def test_bands_follow_the_limit():
    from digestry.llm.minhash import BAND_ROWS, MISSED, permutations_for
    assert (permutations_for(85), permutations_for(80)) == (50, 73)
    for percent in (60, 70, 75, 80, 85, 90, 95, 100):
        assert (1 - (percent / 100) ** BAND_ROWS) ** (2 * permutations_for(percent) // BAND_ROWS) <= MISSED
