import random

import pytest

from digestry.llm import decontaminate as D

random.seed(8)
VOCABULARY = ["".join(random.choices("abcdefghij", k=5)) for _ in range(3000)]
words = lambda n: " ".join(random.choices(VOCABULARY, k=n))
ITEM = "A train leaves Ulm at 9 and covers 120 km, then its driver Paul rests 15 min before Paul drives 120 km more to the old harbour"
BENCH = [(1, words(40)), (2, words(12)), (3, ITEM), (4, None), (5, "too short"), (6, words(60)), (None, words(30)), (7, "1 2 3 4 5 6 7 8 9 10 11 12")]


def found(spark, docs, bench=BENCH):
    rows = spark.createDataFrame([(i, t, "k", True) for i, t in docs], "doc_id long, text string, text_key string, contaminated boolean")
    got = D.decontaminate(rows, spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert len(got) == len(docs)
    return {r.doc_id: r["items"] for r in got}, {r.doc_id: r.contaminated for r in got}


def test_items_partial_items_and_reparameterised_ones(spark):
    changed = ITEM.replace("120", "75").replace("Paul", "Olga").replace("9", "11").replace("min", "hours").replace("15", "2")
    mixed = ITEM.replace("120 km,", "75 km,").replace("then its driver Paul", "then its driver Olga").replace("Ulm", "Rom").replace("15 min", "2 hours").replace("km more", "m more")
    docs = [(10, words(100) + " " + BENCH[0][1] + " " + words(90)), (11, words(33) + "\n" + BENCH[1][1].upper() + "!\n" + words(7)),
            (12, words(20) + ", " + changed + ". " + words(20)), (13, ITEM), (14, words(300)), (15, None), (16, ""), (17, "x"),
            (18, " ".join(BENCH[5][1].split()[20:36])), (19, " ".join(BENCH[5][1].split()[20:31])), (20, BENCH[0][1] + " " + BENCH[1][1]),
            (21, "1 2 3 4 5 6 7 8 9 10 11 12 13 14"), (22, mixed), (None, words(4) + BENCH[0][1]), (23, words(50_000) + " " + BENCH[1][1])]
    items, flags = found(spark, docs)
    assert items == {10: [1], 11: [2], 12: [3], 13: [3], 14: [], 15: [], 16: [], 17: [], 18: [6], 19: [], 20: [1, 2], 21: [], 22: [], None: [1], 23: [2]}
    assert flags == {k: bool(v) for k, v in items.items()}


def test_every_offset_is_met(spark):
    docs = [(k, words(k) + " " + BENCH[1][1] + " " + words(5)) for k in range(12)]
    assert found(spark, docs)[0] == {k: [2] for k in range(12)}


def test_shuffled_windows_and_copies(spark, monkeypatch):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", 0)
    docs = [(k, "start " + BENCH[0][1]) for k in range(50)] + [(99, words(30)), (99, words(30))]
    assert found(spark, docs)[0] == {**{k: [1] for k in range(50)}, 99: []}


@pytest.mark.parametrize("docs, bench", [([], BENCH), ([(1, BENCH[0][1])], []), ([], [])])
def test_empty_tables(spark, docs, bench):
    assert found(spark, docs, bench)[0] == {i: [] for i, _ in docs}


def test_templates(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(D.template_words(F.lit("He paid 3.5 USD, said Ann Lee #1 to Bob in 10 km.")).alias("w"),
                                D.template_words(F.lit("I saw Ann, 12 kg"), values=True).alias("v")).first()
    assert row.w == ["he", "paid", "#num", "#num", "#unit", "said", "#name", "#name", "#num", "to", "#name", "in", "#num", "#unit"]
    assert row.v == ["i", "saw", "#name\1ann", "#num\1" + "12", "#unit\1kg"]


SHORT = [(1, "What year did Rome fall?"), (2, "Add 3 kg, 4 kg, 5 kg and 6 kg"), (3, "Compute 17 * 23 + 4 / 2 - 9"), (4, "Ask whether Paul Ann or Eve paid"),
         (5, "Sort 5, 6, 7 and 8 kg then say which of these was last")]


@pytest.mark.parametrize("item", SHORT, ids=lambda x: str(x[0]))
def test_short_items_and_numbers_at_every_offset(spark, item):
    docs = [(k, words(k) + ". " + item[1] + " " + words(5)) for k in range(1, 9)] + [(20 + k, words(k) + ", " + item[1] + ", " + words(5)) for k in range(4)]
    docs += [(30, words(3) + " " + item[1].lower() + " " + words(9)), (31, words(3) + " " + item[1].upper() + " " + words(9))]
    assert found(spark, docs, SHORT)[0] == {i: [item[0]] for i, _ in docs}


def test_other_numbers_or_a_part_of_numbers_are_no_item(spark):
    docs = [(1, "Compute 17 * 23 + 4 / 2 - 8"), (2, "Add 3 kg, 4 kg, 5 kg and 7 kg"), (3, words(30) + " then say which of these " + words(30)), (4, "Compute 17 * 23 + 4 / 2")]
    assert found(spark, docs, SHORT)[0] == {1: [], 2: [], 3: [], 4: []}


def test_ids_of_text_and_carried_columns(spark):
    from digestry.llm import decontaminate as D
    item = "Which of the following rivers flows through the old town of Verona before it reaches the sea?"
    docs = spark.createDataFrame([(1, f"x y z {item} more", "mine", "h"), (2, "nothing", "yours", "h")], "doc_id long, text string, text_key string, h string")
    benchmark = spark.createDataFrame([("q-1", item)], "item_id string, text string")
    got = {r.doc_id: (r["items"], r.text_key, r.h) for r in D.decontaminate(docs, benchmark).collect()}
    assert got == {1: (["q-1"], "mine", "h"), 2: ([], "yours", "h")}
