"""Landed videos, feeds, transcripts, rule tables, logs and sinks."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from digestry import Settings, schema
from digestry.sources import feeds, tables, videos

NOW = datetime(2026, 4, 24, 8, tzinfo=timezone.utc)
S = Settings(as_of=NOW)


def test_video_payloads(spark, tmp_path):
    full = {"id": "v1", "snippet": {"title": "T", "channelTitle": "C", "description": "d" * 3000,
                                    "publishedAt": "2026-04-24T01:02:03Z"},
            "statistics": {"viewCount": "12", "likeCount": "3", "commentCount": "1"},
            "contentDetails": {"duration": "PT1M"}}
    bare = {"id": "v2", "snippet": {"title": "U", "channelTitle": "C", "publishedAt": "never"},
            "contentDetails": {"duration": "PT2M"}}
    path = tmp_path / "page.json"
    path.write_text(json.dumps({"items": [full, bare]}) + "\n" + json.dumps({"items": []}) + "\nnot json\n")
    out = {r.item_id: r for r in videos.flatten_payloads(videos.parse_payloads(videos.read_payloads(spark, str(path)))).collect()}
    assert set(out) == {"v1", "v2"}
    assert (out["v1"].views, out["v1"].likes, out["v1"].comments, len(out["v1"].description)) == (12, 3, 1, 2000)
    assert (out["v2"].views, out["v2"].description, out["v2"].published_at) == (0, "", None)
    assert out["v1"].url == "https://youtube.com/watch?v=v1"


def test_channel_limit_comes_before_the_time_filter(spark):
    known = S.channels[5][0]
    rows = [(known, i, NOW - timedelta(hours=h)) for i, h in enumerate([1, 2, 3, 30, 40, 4, 5])]
    rows += [("unknown", 9, NOW)]
    df = spark.createDataFrame(rows, "channel_id string, ord bigint, published_at timestamp")
    out = videos.latest_of_channels(df, S).collect()
    assert sorted(r.ord for r in out) == [0, 1, 2, 5, 6] and {r.domain for r in out} == {"机器人"}
    edge = spark.createDataFrame([(known, 1, NOW - timedelta(days=1) + timedelta(milliseconds=1)),
                                  (known, 2, NOW - timedelta(days=1)), (known, 3, NOW - timedelta(days=1, seconds=1))],
                                 "channel_id string, ord bigint, published_at timestamp")
    assert sorted(r.ord for r in videos.latest_of_channels(edge, S).collect()) == [1, 2]


def test_keyword_search(spark):
    s = S.with_(search_keywords=(("AI", ("Chip",)), ("芯片", ("chip", "gpu"))))
    rows = [(str(i), i, t, "", NOW - timedelta(hours=1)) for i, t in enumerate(
        ["chip chip", "a CHIP", "gpu chipchip chip", "none", "chip", "chip", "chip", "chip"])]
    rows.append(("old", 99, "chip", "", NOW - timedelta(days=2)))
    df = spark.createDataFrame(rows, "item_id string, ord bigint, title string, description string, published_at timestamp")
    out = [(r.keyword, r.domain, r.place, r.item_id, r.occurrences)
           for r in videos.best_of_keywords(df, s).orderBy("keyword_ord", "place").collect()]
    assert out[:5] == [("Chip", "AI", 1, "2", 3), ("Chip", "AI", 2, "0", 2), ("Chip", "AI", 3, "1", 1),
                       ("Chip", "AI", 4, "4", 1), ("Chip", "AI", 5, "5", 1)]
    assert len(out) == 11 and out[-1] == ("gpu", "芯片", 1, "2", 1)


def test_first_row_per_id(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "early"), ("b", 3, "only")], "item_id string, ord int, d string")
    assert sorted(r.d for r in videos.first_per_id(df).collect()) == ["early", "only"]


def test_transcripts(spark):
    rows = [(1, "zh", 0, "z"), (1, "en", 1, "b"), (1, "en", 0, "a"), (2, "fr", 0, "f"), (3, "zh", 0, "x"),
            (3, "zh-Hans", 0, "y")] + [(4, "en", i, f"s{i}") for i in range(250)] + [(5, "en", 0, "k" * 4000)]
    texts = videos.transcripts(spark.createDataFrame(rows, "video_id bigint, lang string, pos int, text string"))
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "video_id bigint")
    out = {r.video_id: r.transcript for r in videos.with_transcripts(ids, texts).collect()}
    assert (out[1], out[2], out[3]) == ("a b", "", "y")
    assert out[4] == " ".join(f"s{i}" for i in range(200)) and len(out[5]) == 3000


RSS = """<?xml version="1.0"?><rss version="2.0"><channel><title>Feed</title>
<item><title>GPU &amp; chip</title><guid isPermaLink="false">g1</guid><link>https://x/1</link>
<description><![CDATA[<p>An <b>AI</b> text</p>]]></description><pubDate>Fri, 24 Apr 2026 07:00:00 GMT</pubDate></item>
<item><title>Old</title><link>https://x/2</link><pubDate>Wed, 22 Apr 2026 07:00:00 +0000</pubDate></item>
<item><title>No time</title><description>plain</description></item>
<item><title>Offset</title><link>https://x/4</link><pubDate>Thu, 23 Apr 2026 10:30:00 +0200</pubDate></item>
<item><title>Dated in words</title><pubDate>yesterday</pubDate></item>
</channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
<entry><id>a1</id><title>Robot</title><link rel="self" href="https://y/self"/><link href="https://y/1"/>
<summary>humanoid</summary><updated>2026-04-24T05:00:00Z</updated></entry>
<entry><title>Bare</title></entry></feed>"""


def test_feeds(spark, tmp_path):
    (tmp_path / "TechCrunch.xml").write_text(RSS)
    (tmp_path / "The Verge AI.xml").write_text(ATOM)
    (tmp_path / "Ars Technica.xml").write_text(
        "<rss><channel>" + "".join(f"<item><title>t{i}</title></item>" for i in range(30)) + "</channel></rss>")
    (tmp_path / "Unknown.xml").write_text(RSS)
    (tmp_path / "MIT Tech Review.xml").write_text("this is not XML")
    out = feeds.feed_entries(feeds.read_documents(spark, str(tmp_path)), S, tables.feeds_table(spark, S)).collect()
    rows = {(r.channel, r.item_id): r for r in out}
    first = rows["TechCrunch", "g1"]
    assert (first.title, first.description, first.domain, first.url, first.authority) == (
        "GPU & chip", "An AI text", "芯片", "https://x/1", "high")
    assert first.published_at is not None and first.views == 0
    assert {k[1] for k in rows if k[0] == "TechCrunch"} == {"g1", "No time", "https://x/4", "Dated in words"}
    atom = rows["The Verge AI", "a1"]
    assert (atom.url, atom.description, atom.domain) == ("https://y/1", "humanoid", "AI")
    assert ("The Verge AI", "Bare") in rows
    assert sorted(r.entry_no for r in out if r.channel == "Ars Technica") == list(range(20))
    assert not any(r.channel in ("Unknown", "MIT Tech Review") for r in out)


def test_feed_without_domains(spark):
    rows = tables.feeds_table(spark, S.with_(feeds=({"url": "u", "name": "n", "lang": "en", "domains": ()},)))
    docs = spark.createDataFrame([("n", RSS)], "feed_name string, content string")
    assert feeds.feed_entries(docs, S, rows).count() == 0 and feeds.feeds_without_domains(rows).count() == 1


@pytest.mark.parametrize("text, iso", [
    ("Fri, 24 Apr 2026 07:00:00 GMT", "2026-04-24T07:00:00"), ("4 Apr 2026 07:00:00 -0130", "2026-04-04T08:30:00"),
    ("2026-04-24T07:00:00Z", "2026-04-24T07:00:00"), ("Fri, 24 Apr 2026 07:00 UT", "2026-04-24T07:00:00"),
    ("soon", None)])
def test_feed_times(spark, text, iso):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(F.unix_timestamp(feeds.parse_time(F.col("t")))).first()[0]
    expected = iso and int(datetime.fromisoformat(iso + "+00:00").timestamp())
    assert got == expected


def test_script_table(spark):
    df = spark.createDataFrame([("a", "zh", "機器人"), ("b", "en", "機")], "item_id string, lang string, title string")
    table = ("機", "机")
    one = {r.item_id: r.title for r in videos.simplified(df, table, ["title"], "zh").collect()}
    every = {r.item_id: r.title for r in videos.simplified(df, table, ["title"]).collect()}
    assert one == {"a": "机器人", "b": "機"} and every == {"a": "机器人", "b": "机"}


def test_union_keeps_source_order(spark):
    a = spark.createDataFrame([("v", 1, "x")], "item_id string, ord bigint, duration string")
    b = spark.createDataFrame([("v", 1, "high")], "item_id string, ord bigint, authority string")
    out = videos.collected([a, b]).orderBy("source_no").collect()
    assert [(r.source_no, r.item_id, r.duration, r.authority) for r in out] == [(0, "v", "x", None), (1, "v", None, "high")]


def test_rule_tables(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([("b", 2, "k3", 1), ("a", 1, "k2", 2), ("a", 1, "k1", 1)],
                          schema.RULE_TABLES["domain_keywords"]).write.parquet(f"{folder}/domain_keywords")
    spark.createDataFrame([("c",)], schema.RULE_TABLES["whitelist"]).write.parquet(f"{folder}/whitelist")
    s = tables.settings_from_tables(spark, folder)
    assert s.domain_keywords == (("a", ("k1", "k2")), ("b", ("k3",)))
    assert s.whitelist == ("c",) and s.spam_keywords == () and s.domains == ("AI", "芯片", "机器人")
    assert tables.read_rules(spark, folder, "feeds").count() == 0


def test_reaction_log_loses_only_bad_lines(spark, tmp_path):
    path = tmp_path / "log"
    path.mkdir()
    (path / "a.json").write_text('{"event_ord":1,"user_id":1,"item_id":"i","reaction":"like"}\n{broken\n')
    good, bad = tables.read_reactions(spark, str(path))
    assert (good.count(), bad.count()) == (1, 1)
    tables.append_reactions(good, str(path))
    assert tables.read_reactions(spark, str(path))[0].count() == 2
    assert tables.read_reactions(spark, str(tmp_path / "none"))[0].count() == 0


def test_briefing_sink_replaces_one_date(spark, tmp_path):
    path = str(tmp_path / "out")

    def docs(text, day):
        return spark.createDataFrame([(1, text, day)], "brief_id bigint, md string, brief_date string")

    for text, day in (("a", "2026-04-23"), ("b", "2026-04-24"), ("c", "2026-04-24")):
        tables.write_briefings(docs(text, day), path)
    assert {(str(r.brief_date), r.md) for r in spark.read.parquet(path).collect()} == {
        ("2026-04-23", "a"), ("2026-04-24", "c")}


def test_unreadable_rule_files_are_named(spark, tmp_path):
    spark.createDataFrame([("c", "AI", 1)], schema.RULE_TABLES["channels"]).coalesce(1).write.parquet(str(tmp_path / "channels"))
    (tmp_path / "channels" / "part-broken.parquet").write_bytes(b"PAR1 not really")
    (tmp_path / "whitelist").mkdir()
    (tmp_path / "whitelist" / "x.parquet").write_bytes(b"nothing")
    found = {(r.name, r.file.rsplit("/", 1)[-1]) for r in tables.unread_rules(spark, str(tmp_path)).collect()}
    assert found == {("channels", "part-broken.parquet"), ("whitelist", "x.parquet")}
    s = tables.settings_from_tables(spark, str(tmp_path))
    assert s.channels == (("c", "AI"),) and s.whitelist == () and s.domains == Settings().domains
    assert tables.unread_rules(spark, str(tmp_path / "none")).count() == 0


def test_only_a_missing_log_is_empty(spark, tmp_path):
    good, bad = tables.read_reactions(spark, str(tmp_path / "none"))
    assert good.count() == bad.count() == 0
    with pytest.raises(Exception):
        tables.read_reactions(spark, "unknown-scheme://log")[0].collect()
