"""Reactions: latest, weights, statistics, request log, documents read back, stream."""

import random
from urllib.parse import parse_qsl, quote, urlsplit

import pytest
from pyspark.sql import functions as F

from digestry import Settings, schema
from digestry.operators import feedback
from digestry.streaming import reactions as stream


def events(spark, rows):
    full = [(i, None, user, item, reaction, "t", channel, domain)
            for i, (user, item, reaction, channel, domain) in enumerate(rows)]
    return spark.createDataFrame(full, schema.FEEDBACK_EVENTS)


def test_weights_count_every_event_and_stats_the_latest(spark):
    df = events(spark, [(1, "i", "like", "c", "d"), (1, "i", "like", "c", "d"), (1, "i", "dislike", "c", "d"),
                        (1, "5", "like", "", "")])
    assert [(r.channel, r.weight) for r in feedback.weights(df, "channel").collect()] == [("c", 0.0)]
    assert [(r.domain, r.weight) for r in feedback.weights(df, "domain").collect()] == [("d", 0.0)]
    assert tuple(feedback.reaction_stats(df).first()) == (1, 2, 1, 1)
    latest = {r.item_id: r.reaction for r in feedback.latest_reactions(df).collect()}
    assert latest == {"i": "dislike", "5": "like"}


LOGGED = [  # address, and (item, reaction, title) or None
    ("/feedback?id=1&r=like&t=a%20b", ("1", "like", "a b")),
    ("/feedback?id=1&r=like", ("1", "like", "")),
    ("/feedback?id=&r=like", None),
    ("/feedback", None),
    ("/feedback?id=2&r=dislike#x&t=1", ("2", "dislike", "")),
    ("/feedback/?id=1&r=like", None),
    ("/feedback?t=x&id=&id=7&r=&r=like", ("7", "like", "x")),
    ("/feedback?id=1&r=like&t=100%zz", ("1", "like", "100%zz")),
    ("/feedback?id=1&r=like&t=a%20b%zz+c", ("1", "like", "a b%zz c")),
    ("/feedback;x?id=1&r=like", ("1", "like", "")),
    ("/feedback?%69d=3&r=like", ("3", "like", "")),
    ("/other?id=1&r=like", None),
    ("/feedback?xid=1&r=like", None),
    ("/feedback?id=a+b&r=like", ("a b", "like", "")),
    ("/feedback?x=1?id=5&r=like", None),
    ("/feedback?id=1?&r=like", ("1?", "like", "")),
    ("/feedback?id=a=b&r=like", ("a=b", "like", "")),
    ("/feedback??id=1&r=like", None),
    ("/feedback?id=1&r=maybe", None),
    ("/feedback?id=" + quote("机") + "&r=dislike&t=" + quote("机器人 & co"), ("机", "dislike", "机器人 & co")),
]


def in_query(url):
    """By pairs of the query as the standard library splits it: the first value given for each name."""
    given = {}
    for name, value in parse_qsl(urlsplit(url).query):
        given.setdefault(name, value)
    ok = given.get("id") and given.get("r") in {"like", "dislike"}
    return (given["id"], given["r"], given.get("t", "")) if ok else None


def test_request_log(spark):
    rnd = random.Random(5)
    pieces = ["id=1", "id=", "id=%20x", "r=like", "r=dislike", "r=no", "t=a+b", "t=%41", "&", "x=1", "?", "t=?id=3", "%74=q", "t=5%"]
    random_ones = ["/feedback?" + "&".join(rnd.choices(pieces, k=rnd.randint(1, 5))) for _ in range(200)]
    cases = LOGGED + [(u, in_query(u)) for u in random_ones]
    log = spark.createDataFrame([(i, None, 1, u) for i, (u, _) in enumerate(cases)], schema.REQUEST_LOG)
    got = {r.event_ord: (r.item_id, r.reaction, r.title) for r in feedback.from_request_log(log.withColumn("brief_id", F.lit(4))).collect()}
    assert got == {i: e for i, (_, e) in enumerate(cases) if e}
    assert feedback.from_request_log(log.withColumn("brief_id", F.lit(4))).columns[-1] == "brief_id"


def test_keyword_weights_and_examples(spark):
    rows = [(0, None, 1, "a", "like", "GPU news", "", ""), (1, None, 1, "b", "dislike", "gpu and chip", "", ""), (2, None, 1, "a", "dislike", "GPU news", "", ""),
            (3, None, 2, "c", "like", None, "", ""), (4, None, 1, "d", "like", "chip", "", "")]
    df = spark.createDataFrame(rows, schema.FEEDBACK_EVENTS)
    s = Settings().with_(domain_keywords=(("AI", ("GPU", "chip")), ("x", ("GPU",))))
    assert {(r.user_id, r.keyword): r.weight for r in feedback.keyword_weights(df, s).collect()} == {(1, "GPU"): -3.0, (1, "chip"): -1.0}
    assert sorted(map(tuple, feedback.preference_examples(df, 1).collect()), key=str) == [
        (1, "dislike", 1, "a", "GPU news"), (1, "like", 1, "d", "chip"), (2, "like", 1, "c", None)]


def test_restored_items_move_weights(spark):
    df = events(spark, [(1, "1", "like", "", ""), (1, "9", "like", "", "")]).withColumn("brief_id", F.lit(4).cast("bigint"))
    items = spark.createDataFrame([(4, 1, "c", "AI")], "brief_id bigint, number bigint, channel string, domain string")
    out = feedback.restore_items(df, items)
    assert {(r.channel, r.weight) for r in feedback.weights(out, "channel").collect()} == {("c", 1.0)}


DOC = """# head

## 🤖 AI领域（2 条）

### 1. First. title
📺 YouTube · Chan nel · 8 分钟
text
### 2. Second
📝 Paper

## no section
### Third
## 🦾 机器人领域（1 条）
### 3. 芯片 x
📺 YouTube ·　Spaced　· 1 分钟"""


def test_documents_are_read_back(spark):
    docs = spark.createDataFrame([(1, DOC), (2, "nothing")], "brief_id bigint, md string")
    out = feedback.parse_briefings(docs, Settings()).orderBy("number").collect()
    assert [tuple(r)[1:] for r in out] == [
        (1, "First. title", "Chan nel", "AI"), (2, "Second", "", "AI"), (3, "Third", "", "AI"),
        (4, "芯片 x", "Spaced", "机器人")]
    votes = spark.createDataFrame([(1, 1, "like"), (1, 9, "like"), (1, 2, "maybe"), (2, 1, "like")],
                                  "brief_id bigint, number bigint, reaction string")
    joined = feedback.reactions_by_number(votes, feedback.parse_briefings(docs, Settings())).collect()
    assert [(r.item_id, r.reaction, r.channel) for r in joined] == [("First. title", "like", "Chan nel")]


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_stream_equals_batch(spark, tmp_path, files_per_batch):
    rnd = random.Random(9)
    rows = [(rnd.randint(1, 3), f"i{rnd.randint(0, 9)}", rnd.choice(["like", "dislike"]), rnd.choice(["", "a", "b"]),
             rnd.choice(["", "AI"])) for _ in range(300)]
    df = events(spark, rows).drop("ts")
    log = str(tmp_path / "log")
    for part in range(4):  # four files, written one after the other
        df.where(F.col("event_ord") % 4 == part).coalesce(1).write.mode("append").parquet(log)
    read = stream.read_log(spark, log, df.schema, files_per_batch)
    kept, progress = str(tmp_path / "w"), str(tmp_path / "wp")
    stream.maintain_weights(read, "channel", kept, progress).awaitTermination()
    got = {tuple(r) for r in stream.current_weights(spark, kept, "channel").collect()}
    assert got == {tuple(r) for r in feedback.weights(df, "channel").collect()}
    latest, progress = str(tmp_path / "l"), str(tmp_path / "lp")
    stream.maintain_latest(read, latest, progress).awaitTermination()
    current = stream.current_latest(spark, latest)
    expected = feedback.latest_reactions(df)
    assert sorted(map(tuple, current.collect())) == sorted(map(tuple, expected.select(*current.columns).collect()))


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    log, kept, progress = (str(tmp_path / n) for n in ("log", "kept", "progress"))
    first = events(spark, [(1, "i", "like", "c", "")]).drop("ts")
    first.write.parquet(log)
    for more in (None, events(spark, [(1, "j", "dislike", "c", ""), (2, "j", "like", "c", "")]).drop("ts")):
        if more is not None:
            more.write.mode("append").parquet(log)
        stream.maintain_weights(stream.read_log(spark, log, first.schema), "channel", kept, progress).awaitTermination()
    got = {(r.user_id, r.weight) for r in stream.current_weights(spark, kept, "channel").collect()}
    assert got == {(1, -1.0), (2, 1.0)}


def test_stream_from_the_request_log(spark, tmp_path):
    """Clicks as they arrive, from addresses to statistics."""
    lines = [(i, None, 1, url) for i, url in enumerate(
        ["/feedback?id=1&r=like&t=x", "/feedback?id=1&r=dislike", "/feedback?id=2&r=like", "/feedback?id=2&r=no", "/"])]
    log = str(tmp_path / "requests")
    for part in range(5):
        spark.createDataFrame(lines[part:part + 1], schema.REQUEST_LOG).write.mode("append").json(log)
    requests = stream.read_log(spark, log, schema.REQUEST_LOG, 2, "json")
    kept = str(tmp_path / "kept")
    query = stream.maintain_latest(feedback.from_request_log(requests).drop("ts"), kept, str(tmp_path / "progress"))
    query.awaitTermination()
    latest = stream.current_latest(spark, kept)
    assert tuple(feedback.stats_of_latest(latest).first()) == (1, 2, 1, 1)
    kept_table = stream.latest_table(kept)
    kept_table.merge_before(spark, 100)
    assert sorted(map(tuple, kept_table.current(spark).collect())) == sorted(map(tuple, latest.collect()))


def test_weights_of_several_keys_at_once(spark):
    rnd = random.Random(3)
    rows = [(rnd.randint(1, 3), f"i{i}", rnd.choice(["like", "dislike", None]), rnd.choice(["", "a", "b", None]), rnd.choice(["", "AI", None])) for i in range(200)]
    df = events(spark, rows)
    both = feedback.learned_weights(df)
    for name, key in (("source_weights", "channel"), ("domain_weights", "domain")):
        assert sorted(map(tuple, both[name].collect())) == sorted(map(tuple, feedback.weights(df, key).collect()))
