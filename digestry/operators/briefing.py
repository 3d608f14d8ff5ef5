"""From the selection of each briefing to its document. A selection is small: at most `total` items."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from digestry import rules
from digestry.functions import text as X
from digestry.settings import Settings


def attach_summaries(items: DataFrame, responses: DataFrame) -> DataFrame:
    """Add `summary` and `why_it_matters` from generated answers; without one, the start of the description.

    Of several answers to an item the latest by `answer_ord` counts, if the table has that column, and a failed one
    only where there is no other; of equals the greatest text.
    """
    latest = [F.col("answer_ord")] if "answer_ord" in responses.columns else []
    answers = (responses.groupBy("item_id")
               .agg(F.max(F.struct(F.col("raw").isNotNull().alias("_said"), *latest, F.col("raw").alias("_raw"))).alias("_a"))
               .select("item_id", "_a._raw"))
    summary, why = X.parse_response(F.col("_raw"))
    failed = F.col("_raw").isNull()
    return (items.join(answers, "item_id", "left")
            .withColumn("summary", F.when(failed, F.substring(X.text_or_empty(F.col("description")), 1, 200))
                        .otherwise(summary))
            .withColumn("why_it_matters", F.when(failed, "").otherwise(why))
            .drop("_raw"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} places; text coming in is never read as a template again."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = {name: rest.find("{" + name + "}") for name in values}
        at = {name: i for name, i in at.items() if i >= 0}
        if not at:
            parts.append(F.lit(rest))
            break
        name = min(at, key=at.get)
        parts += [F.lit(rest[:at[name]]), values[name]]
        rest = rest[at[name] + len(name) + 2:]
    return F.concat(*parts)


def item_prompts(items: DataFrame) -> DataFrame:
    """Add `prompt`, the text an external model is to answer for the item."""
    return items.withColumn("prompt", _filled(rules.ITEM_PROMPT, {
        "title": X.text_or_empty(F.col("title")), "channel": X.text_or_empty(F.col("channel")),
        "description": F.substring(X.text_or_empty(F.col("description")), 1, 1000),
        "transcript": F.substring(X.text_or_empty(F.col("transcript")), 1, 1500)}))


def trend_prompts(selected: DataFrame, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """One prompt per briefing over its selected items, in order of selection."""
    line = F.concat(F.lit("- ["), X.text_or_empty(F.col("domain")), F.lit("] "), X.text_or_empty(F.col("title")),
                    F.lit(": "), X.text_or_empty(F.col("summary")))
    lines = F.array_sort(F.collect_list(F.struct("pick", line.alias("line"))))
    joined = F.array_join(F.transform(F.col("_lines"), lambda e: e["line"]), "\n")
    return (selected.groupBy(*keys).agg(lines.alias("_lines"))
            .select(*keys, _filled(rules.TREND_PROMPT, {"items_summary": joined}).alias("prompt")))


def sections(selected: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """Place items in the sections of their briefing: `domain_ord`, `number` (runs on), `domain_count`.

    Items of domains that are not configured have no section.
    """
    position = F.array_position(F.array(*[F.lit(d) for d in s.domains]), F.col("domain"))
    brief = Window.partitionBy(*keys)
    return (selected.withColumn("domain_ord", position.cast("bigint")).where(F.col("domain_ord") > 0)
            .withColumn("number", F.row_number().over(brief.orderBy("domain_ord", "pick")).cast("bigint"))
            .withColumn("domain_count", F.count("*").over(Window.partitionBy(*keys, "domain"))))


def source_line(kind: Column, channel: Column, duration: Column) -> Column:
    name = X.text_or_empty(channel)
    video = F.concat(F.lit("📺 YouTube · "), name, F.lit(" · "), X.duration_label(duration))
    return F.when(kind == "YouTube", video).otherwise(F.concat(F.lit("📝 "), name))


def link_label(kind: Column) -> Column:
    return F.when(kind == "YouTube", "观看原视频").otherwise("阅读原文")


def with_rate(counts: DataFrame, part: str = "selected", whole: str = "collected") -> DataFrame:
    return counts.withColumn("rate", X.one_decimal_percent(F.col(part), F.col(whole)))


def _no_lines() -> Column:
    return F.array().cast("array<string>")


def _in_domain(domain: str) -> Callable[[Column], Column]:
    return lambda e: e["domain"] == domain


def _item_lines(offset: Column) -> Callable[[Column, Column], Column]:
    """Lines of the i-th item of a section whose numbers start after `offset`."""

    def lines(e: Column, i: Column) -> Column:
        why = F.when(e["why"] != "", F.array(F.concat(F.lit("💡 **Why it matters**: "), e["why"])))
        title = F.concat(F.lit("### "), (offset + i + 1).cast("string"), F.lit(". "), X.text_or_empty(e["title"]))
        link = F.concat(F.lit("🔗 ["), link_label(e["kind"]), F.lit("]("), X.text_or_empty(e["url"]), F.lit(")\n"))
        return F.concat(F.array(title, source_line(e["kind"], e["channel"], e["duration"]), e["summary"]),
                        why.otherwise(_no_lines()), F.array(link))

    return lines


def documents(selected: DataFrame, totals: DataFrame, s: Settings, trends: DataFrame | None = None,
              keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """One Markdown document per briefing of `totals` (keys, collected); briefings without items get one too.

    `selected` carries summary and why_it_matters. Lines are put together inside the row of a briefing.
    """
    keys = list(keys)
    entry = F.struct("pick", F.coalesce("domain", F.lit("other")).alias("domain"), "title", "kind", "channel",
                     "duration", "url", X.text_or_empty(F.col("summary")).alias("summary"),
                     X.text_or_empty(F.col("why_it_matters")).alias("why"))
    lists = selected.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_items"))
    rows = totals.join(lists, keys, "left")
    rows = (rows.join(trends.select(*keys, "trend"), keys, "left") if trends is not None
            else rows.withColumn("trend", F.lit(None).cast("string")))

    icons = dict(rules.DOMAIN_ICONS)
    missing = F.col("_items").isNull()
    count = F.when(missing, 0).otherwise(F.size("_items"))
    body, offset = [], F.lit(0)
    for domain in s.domains:
        mine = F.filter("_items", _in_domain(domain))
        size = F.when(missing, 0).otherwise(F.size(mine))
        heading = F.concat(F.lit(f"## {icons.get(domain, rules.DEFAULT_ICON)} {domain}领域（"), size.cast("string"),
                           F.lit(" 条）\n"))
        body.append(F.when(size > 0, F.concat(F.array(heading), F.flatten(F.transform(mine, _item_lines(offset))),
                                              F.array(F.lit("---\n")))).otherwise(_no_lines()))
        offset = offset + size

    total, n = F.col("collected").cast("string"), count.cast("string")
    head = F.array(
        F.lit(f"# {rules.REPORT_NAME} — {s.as_of:%Y.%m.%d}（{rules.WEEKDAYS[s.as_of.weekday()]}）\n"),
        F.concat(F.lit("> 今日共采集 "), total, F.lit(" 条内容，精选 "), n, F.lit(" 条高质量信息。\n")),
        F.lit("---\n"))
    tail = F.array(
        F.concat(F.lit("📊 **今日数据**：采集 "), total, F.lit(" 条 → 精选 "), n, F.lit(" 条（入选率 "),
                 X.one_decimal_percent(count, F.col("collected")), F.lit("%）")),
        F.concat(F.lit("💡 **趋势洞察**："), F.coalesce("trend", F.lit(rules.DEFAULT_TREND)), F.lit("\n")),
        *[F.lit(line) for line in rules.FOOTER])
    return rows.select(*keys, F.array_join(F.concat(head, *body, tail), "\n").alias("md"))


def document_lines(docs: DataFrame, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    return (docs.select(*keys, F.posexplode(F.split("md", "\n")).alias("_at", "line"))
            .select(*keys, (F.col("_at") + 1).cast("bigint").alias("line_no"), "line"))
