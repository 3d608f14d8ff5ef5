"""One small run from landed data to messages."""

import json
from datetime import datetime, timezone

from digestry import Settings, schema
from digestry.plans.daily import as_items, brief, collect_articles, collect_videos
from digestry.sources import tables, videos

S = Settings(as_of=datetime(2026, 4, 24, 8, tzinfo=timezone.utc))


def video(number, title, channel_id, hour, views=20000, likes=3000):
    return {"id": f"v{number}", "snippet": {"title": title, "channelId": channel_id, "channelTitle": f"ch{channel_id[-2:]}",
                                            "description": "", "publishedAt": f"2026-04-24T{hour:02d}:00:00Z"},
            "statistics": {"viewCount": str(views), "likeCount": str(likes)}, "contentDetails": {"duration": "PT12M"}}


def test_run(spark):
    chips, robots = S.channels[6][0], S.channels[5][0]
    pages = [json.dumps({"items": [
        video(1, "機器 robot GPU chip LLM", robots, 5), video(2, "Same story about chip", chips, 6),
        video(3, "NVIDIA GPU launch", "unsubscribed", 4), video(4, "unrelated", "unsubscribed", 4)]})]
    payloads = videos.parse_payloads(spark.createDataFrame([(p,) for p in pages], "payload string"))
    snippets = spark.createDataFrame([("v1", "en", 0, "hello"), ("v1", "en", 1, "world"), ("v4", "en", 0, "no")],
                                     "video_id string, lang string, pos int, text string")
    landed = collect_videos(payloads, snippets, S, ("機", "机"))
    rows = {r.item_id: r for r in landed.collect()}
    assert set(rows) == {"v1", "v2", "v3"}
    assert (rows["v1"].title[:2], rows["v1"].domain, rows["v1"].transcript) == ("机器", "机器人", "hello world")
    assert (rows["v2"].domain, rows["v3"].domain, rows["v3"].transcript) == ("芯片", "芯片", "")
    assert rows["v1"].ord < rows["v2"].ord < rows["v3"].ord

    rss = ("<rss><channel><item><title>Same story about chip</title><guid>a1</guid><description>" + "gpu " * 300
           + "</description><pubDate>Fri, 24 Apr 2026 07:00:00 GMT</pubDate></item></channel></rss>")
    files = spark.createDataFrame([("36氪", rss)], "feed_name string, content string")
    articles = collect_articles(files, tables.feeds_table(spark, S), S, ("機", "机"))
    items = as_items([landed, articles], 7)
    assert items.schema.simpleString() == schema.ITEMS.simpleString() and items.count() == 4

    answers = spark.createDataFrame([("v2", "摘要：S\nWhy it matters：W")], "item_id string, raw string")
    run = brief(items, S, answers)
    picked = {r.item_id: r.quality_score for r in run.selected.collect()}
    # The article wins over the video with the same title: 25 + 15 + 10 + 10 + 10 against 15 + 15 + 15 + 5 + 10.
    assert picked == {"v1": 15 + 15 + 15 + 20 + 10, "v3": 15 + 15 + 15 + 10 + 10, "a1": 70}
    text = run.documents.first().md
    assert "采集 4 条 → 精选 3 条（入选率 75.0%）" in text and "### 2. NVIDIA GPU launch" in text
    assert run.item_prompts.count() == 3 and run.trend_prompts.count() == 1
    assert json.loads(run.messages.first().payload)["card"]["header"]["template"] == "blue"
