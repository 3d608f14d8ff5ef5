"""Documents and cards of a hand-made selection."""

import json
from datetime import datetime, timezone

from digestry import Settings
from digestry.operators import briefing, card

S = Settings(as_of=datetime(2026, 4, 24, tzinfo=timezone.utc))
SELECTED = ("brief_id bigint, pick bigint, domain string, title string, kind string, channel string, duration string, "
            "url string, summary string, why_it_matters string")
ROWS = [
    (1, 1, "芯片", "Chips", "YouTube", "Bloom", "PT1H2M3S", "u1", "sum1", "why1"),
    (1, 2, "AI", "2. Agents", "RSS", "Paper", "", "u2", "sum2", ""),
    (1, 3, "other", "Left out", "RSS", "Paper", "", "u3", "sum3", ""),
    (1, 4, "AI", "More/agents", "YouTube", "Chan", "bad", "u4", "sum4", ""),
]
EXPECTED = """# 📋 VC 每日简报 — 2026.04.24（周五）

> 今日共采集 128 条内容，精选 4 条高质量信息。

---

## 🤖 AI领域（2 条）

### 1. 2. Agents
📝 Paper
sum2
🔗 [阅读原文](u2)

### 2. More/agents
📺 YouTube · Chan · 
sum4
🔗 [观看原视频](u4)

---

## 🔬 芯片领域（1 条）

### 3. Chips
📺 YouTube · Bloom · 1小时2分钟
sum1
💡 **Why it matters**: why1
🔗 [观看原视频](u1)

---

📊 **今日数据**：采集 128 条 → 精选 4 条（入选率 3.1%）
💡 **趋势洞察**：up

---
> 📬 反馈：点击每条旁的 👍👎 帮助我学习你的偏好
> 🕐 下期简报将于明日 08:00 推送"""


def documents(spark):
    totals = spark.createDataFrame([(1, 128), (2, 5)], "brief_id bigint, collected bigint")
    trends = spark.createDataFrame([(1, "up")], "brief_id bigint, trend string")
    return briefing.documents(spark.createDataFrame(ROWS, SELECTED), totals, S, trends)


def test_document(spark):
    docs = {r.brief_id: r.md for r in documents(spark).collect()}
    assert docs[1] == EXPECTED
    assert "精选 0 条" in docs[2] and "入选率 0.0%" in docs[2] and "暂无趋势洞察。" in docs[2] and "##" not in docs[2]
    lines = briefing.document_lines(documents(spark)).where("brief_id = 1").orderBy("line_no").collect()
    assert "\n".join(r.line for r in lines) == EXPECTED


def test_sections(spark):
    out = briefing.sections(spark.createDataFrame(ROWS, SELECTED), S).orderBy("number").collect()
    assert [(r.title, r.number, r.domain_count) for r in out] == [
        ("2. Agents", 1, 2), ("More/agents", 2, 2), ("Chips", 3, 1)]


def test_summaries(spark):
    items = spark.createDataFrame([("a", "d" * 300), ("b", "d"), ("c", None)], "item_id string, description string")
    answers = spark.createDataFrame([("b", "摘要：x\nWhy it matters：y"), ("c", None)], "item_id string, raw string")
    out = {r.item_id: (r.summary, r.why_it_matters) for r in briefing.attach_summaries(items, answers).collect()}
    assert out == {"a": ("d" * 200, ""), "b": ("x", "y"), "c": ("", "")}


def test_prompts_do_not_expand_what_they_quote(spark):
    items = spark.createDataFrame([("{channel}", "me", "d" * 1200, "t" * 1600)],
                                  "title string, channel string, description string, transcript string")
    prompt = briefing.item_prompts(items).first().prompt
    assert "Title: {channel}\nPublisher: me\n" in prompt and "d" * 1000 + "\n" in prompt and "t" * 1501 not in prompt


def test_card(spark):
    message = json.loads(card.payloads(documents(spark), S).where("brief_id = 1").first().payload)
    body = message["card"]
    assert message["msg_type"] == "interactive"
    assert body["header"] == {"title": {"tag": "plain_text", "content": "📋 VC 每日简报 — 2026.04.24（周五）"},
                              "template": "blue"}
    tags = [e["tag"] for e in body["elements"]]
    assert tags == ["note", "hr", "markdown", "markdown", "action", "markdown", "action", "hr", "markdown", "markdown",
                    "action", "hr", "markdown", "markdown", "hr", "note", "note", "hr", "note"]
    assert body["elements"][3] == {"tag": "markdown", "content": "**1. 2. Agents**\n📝 Paper\nsum2\n🔗 [阅读原文](u2)"}
    assert body["elements"][6]["actions"][1] == {
        "tag": "button", "text": {"tag": "plain_text", "content": "👎 不想看"}, "type": "default",
        "url": "http://localhost:9002/feedback?id=2&r=dislike&t=More/agents"}
    links = card.reaction_links(documents(spark), S).where("brief_id = 1").orderBy("number").collect()
    assert links[0].like_url == "http://localhost:9002/feedback?id=1&r=like&t=2.%20Agents"


def test_card_lines_of_every_kind(spark):
    md = "plain\n## \n#one\n> > note >\n### 7. T\n# kept in block\nx\n##y\n\n###\n  ---  \n# later title"
    docs = spark.createDataFrame([(1, md)], "brief_id bigint, md string")
    rows = card.card_elements(docs, S).orderBy("element_no").collect()
    assert [(r.tag, r.content) for r in rows] == [
        ("markdown", "plain"), ("markdown", "##"), ("markdown", "#one"), ("note", "note >"),
        ("markdown", "**7. T**\n# kept in block\nx"), ("action", None), ("markdown", "##y"), ("markdown", "###"),
        ("hr", None), ("hr", None), ("note", "📬 点击按钮反馈，帮助系统学习你的偏好")]
    assert card.cards(docs, S).first().card.header.title.content == "kept in block"
