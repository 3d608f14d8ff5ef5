"""Message cards with reaction buttons, made from briefing documents. All work stays inside a document's row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry import rules
from digestry.functions import text as X
from digestry.settings import Settings

_BLOCK = "struct<kind:string,text:string,number:int>"
_EXTRA = "array<struct<tag:string,content:string>>"
_ACTIONS = "array<struct<tag:string,text:struct<tag:string,content:string>,type:string,url:string>>"


def _block(kind: str, text: Column, number: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("text"), number.cast("int").alias("number"))


def _blocks(md: Column) -> Column:
    """Typed blocks of a document. A `### ` line takes in the lines up to a blank one, a heading or a rule."""
    lines = F.transform(F.split(md, "\n"), X.strip_blanks)
    start = F.struct(F.lit(False).alias("open"), F.lit(0).alias("items"),
                     F.expr(f"cast(array() as array<{_BLOCK}>)").alias("blocks"))

    def unmarked(line: Column, marks: str) -> Column:
        return X.strip_blanks(F.regexp_replace(line, f"^[{marks}]+", ""))

    def step(acc: Column, line: Column) -> Column:
        ends = (line == "") | line.startswith("##") | (line == "---")
        absorbed = acc["open"] & ~ends
        item = line.startswith("### ")
        nothing = F.lit(None).cast("int")
        fresh = (F.when((line == "") | line.startswith("# "), F.lit(None).cast(_BLOCK))
                 .when(line == "---", _block("rule", F.lit(""), nothing))
                 .when(line.startswith("> "), _block("note", unmarked(line, "> "), nothing))
                 .when(line.startswith("## "), _block("heading", unmarked(line, "# "), nothing))
                 .when(item, _block("item", unmarked(line, "# "), acc["items"] + 1))
                 .otherwise(_block("text", line, nothing)))
        last = F.element_at(acc["blocks"], -1)
        grown = F.array_append(
            F.slice(acc["blocks"], F.lit(1), F.size(acc["blocks"]) - 1),
            F.struct(last["kind"].alias("kind"), F.concat(last["text"], F.lit("\n"), line).alias("text"),
                     last["number"].alias("number")))
        return F.struct(
            F.when(absorbed, True).otherwise(item).alias("open"),
            (acc["items"] + F.when(item & ~absorbed, 1).otherwise(0)).alias("items"),
            F.when(absorbed, grown).when(fresh.isNull(), acc["blocks"])
            .otherwise(F.array_append(acc["blocks"], fresh)).alias("blocks"))

    return F.aggregate(lines, start, step)["blocks"]


def _heading_of(block: Column) -> Column:
    return F.get(F.split(block["text"], "\n"), F.lit(0))


def _encoded_title(heading: Column) -> Column:
    return X.path_encode(F.substring(F.regexp_replace(heading, r"^\d+\.\s*", ""), 1, 50))


def _reaction_url(s: Settings, number: Column, reaction: str, heading: Column) -> Column:
    return F.concat(F.lit(f"{s.feedback_base}/feedback?id="), number.cast("string"), F.lit(f"&r={reaction}&t="),
                    _encoded_title(heading))


def reaction_links(docs: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """Like and dislike address of every item of a document."""
    block = F.col("_block")
    return (docs.select(*keys, F.explode(_blocks(F.col("md"))).alias("_block")).where(block["kind"] == "item")
            .select(*keys, block["number"].cast("bigint").alias("number"),
                    _reaction_url(s, block["number"], "like", _heading_of(block)).alias("like_url"),
                    _reaction_url(s, block["number"], "dislike", _heading_of(block)).alias("dislike_url")))


def _element(tag: str, content: Column | None = None, notes: Column | None = None,
             actions: Column | None = None) -> Column:
    def or_null(value: Column | None, kind: str) -> Column:
        return (F.lit(None) if value is None else value).cast(kind)

    return F.struct(F.lit(tag).alias("tag"), or_null(content, "string").alias("content"),
                    or_null(notes, _EXTRA).alias("elements"), or_null(actions, _ACTIONS).alias("actions"))


def _note(text: Column) -> Column:
    return _element("note", notes=F.array(F.struct(F.lit("plain_text").alias("tag"), text.alias("content"))))


def _elements_of(block: Column, s: Settings) -> Column:
    def button(label: str, kind: str, reaction: str) -> Column:
        return F.struct(F.lit("button").alias("tag"),
                        F.struct(F.lit("plain_text").alias("tag"), F.lit(label).alias("content")).alias("text"),
                        F.lit(kind).alias("type"),
                        _reaction_url(s, block["number"], reaction, _heading_of(block)).alias("url"))

    heading = _heading_of(block)
    whole = F.concat(F.lit("**"), heading, F.lit("**"), F.substr(block["text"], F.length(heading) + 1))
    buttons = F.array(button(rules.LIKE_LABEL, "primary", "like"), button(rules.DISLIKE_LABEL, "default", "dislike"))
    return (F.when(block["kind"] == "rule", F.array(_element("hr")))
            .when(block["kind"] == "note", F.array(_note(block["text"])))
            .when(block["kind"] == "heading",
                  F.array(_element("markdown", F.concat(F.lit("**"), block["text"], F.lit("**")))))
            .when(block["kind"] == "item", F.array(_element("markdown", whole), _element("action", actions=buttons)))
            .otherwise(F.array(_element("markdown", block["text"]))))


def cards(docs: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """One card per document: struct<header, elements>."""
    titles = F.filter(F.split("md", "\n"), lambda line: line.startswith("# "))
    title = X.strip_blanks(F.regexp_replace(F.get(titles, F.lit(0)), "^[# ]+", ""))
    header = F.struct(F.struct(F.lit("plain_text").alias("tag"),
                               F.coalesce(title, F.lit(rules.REPORT_NAME)).alias("content")).alias("title"),
                      F.lit("blue").alias("template"))
    body = F.flatten(F.transform(_blocks(F.col("md")), lambda b: _elements_of(b, s)))
    elements = F.concat(body, F.array(_element("hr"), _note(F.lit(rules.CARD_NOTE))))
    return docs.select(*keys, F.struct(header.alias("header"), elements.alias("elements")).alias("card"))


def card_elements(docs: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """Elements of the cards as rows, in order."""
    return (cards(docs, s, keys).select(*keys, F.posexplode("card.elements").alias("_at", "_e"))
            .select(*keys, (F.col("_at") + 1).cast("bigint").alias("element_no"), F.col("_e.tag").alias("tag"),
                    F.coalesce("_e.content", F.get("_e.elements", F.lit(0))["content"]).alias("content"),
                    F.get("_e.actions", F.lit(0))["url"].alias("like_url"),
                    F.get("_e.actions", F.lit(1))["url"].alias("dislike_url")))


def payloads(docs: DataFrame, s: Settings, keys: Sequence[str] = ("brief_id",)) -> DataFrame:
    """One JSON message per document, ready for a sink."""
    message = F.struct(F.lit("interactive").alias("msg_type"), F.col("card"))
    return cards(docs, s, keys).select(*keys, F.to_json(message).alias("payload"))
