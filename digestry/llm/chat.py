"""Conversations as one training text each, with typed content parts and a loss mask. DataFrame operations only.

A message's content is an ordered array of typed parts. The visitor goes over the parts and flattens them into the
turn's text: text parts are escaped, image, audio and document parts become numbered placeholders, whose references and
expanded token counts are recorded in order. A turn is

    <|im_start|>role\\ncontent<|im_end|>\\n

Escaping puts a backslash between `<` and `|` wherever they meet, also over backslashes already there, so no text can
hold a control string, and taking one backslash out again gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
PART = "struct<kind:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>"

# Tokens that a placeholder stands for once a model expands it.
PATCH = 28            # an image has one token for each patch of this side
AUDIO_PER_SECOND = 25
PER_PAGE = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """One text part; null text is an empty one."""
    none = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"),
                            none.cast("long").alias("width"), none.cast("long").alias("height"), none.cast("double").alias("seconds"),
                            none.cast("long").alias("pages"))).cast(f"array<{PART}>")


def _tokens(part: Column) -> Column:
    side = lambda n: F.ceil(F.greatest(F.coalesce(n, F.lit(1)), F.lit(1)) / PATCH)
    return (F.when(part["kind"] == "image", side(part["width"]) * side(part["height"]))
            .when(part["kind"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * AUDIO_PER_SECOND))
            .when(part["kind"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * PER_PAGE)
            .otherwise(0).cast("long"))


def visited(parts: Column) -> tuple[Column, Column]:
    """Flattened content, and the attachments in order. Unknown kinds and null parts count as text."""
    known = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    media = lambda p: F.coalesce(p["kind"].isin("image", "audio", "document"), F.lit(False))
    attachments = F.transform(F.filter(known, media), lambda p, i: F.struct(
        i.cast("int").alias("number"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    # Neighbouring text parts are joined before they are escaped: a control string may straddle them.
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"), F.lit(0).alias("n"))
    walked = F.aggregate(known, start, lambda a, p: F.when(media(p), F.struct(
        F.concat(a["done"], escaped(a["text"]), F.lit("<|"), p["kind"], F.lit(":"), a["n"].cast("string"), F.lit("|>")).alias("done"),
        F.lit("").alias("text"), (a["n"] + 1).alias("n"))).otherwise(F.struct(
            a["done"].alias("done"), F.concat(a["text"], F.coalesce(p["text"], F.lit(""))).alias("text"), a["n"].alias("n"))),
        lambda a: F.concat(a["done"], escaped(a["text"])))
    return walked, attachments


def format_chat(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts",
                learn: str = "assistant") -> DataFrame:
    """One row per conversation: formatted, turns, loss, attachments, expanded_tokens.

    turns: one row per message with `parts` (array of typed parts, null is empty). Messages go by turn; equal turns
    by role, then content, and null turns first. `loss` has, for each message in order, where in the message's own
    stretch of the text the learned characters begin (from 1) and how many they are, (1, 0) where none; `lengths`
    the characters of each stretch. Null roles are empty. A conversation's text is one value, so it has to fit a
    task; messages are gathered by the map side first.
    """
    name = F.replace(escaped(F.coalesce(F.col(role), F.lit(""))), F.lit("\n"), F.lit(LINE))
    content, attached = visited(F.col(parts))
    made = turns.select(F.col(key).alias(key), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), name.alias("name"),
                        content.alias("content"), attached.alias("attached"))
    head = F.concat(F.lit(START), F.col("name"), F.lit("\n"))
    stretch = F.concat(head, F.col("content"), F.lit(END + "\n"))
    message = F.struct("turn", "role", stretch.alias("stretch"),
                       F.when(F.col("role") == learn, F.length(head) + 1).otherwise(1).cast("int").alias("begin"),
                       F.when(F.col("role") == learn, F.length("content")).otherwise(0).cast("int").alias("learned"), "attached")
    gathered = made.select(key, message.alias("m")).groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("m"))
    media = F.flatten(F.transform("m", lambda m, i: F.transform(m["attached"], lambda a: F.struct(
        i.cast("int").alias("message"), a["number"].alias("number"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return gathered.select(
        key, F.array_join(F.transform("m", lambda m: m["stretch"]), "").alias("formatted"), F.size("m").cast("long").alias("n_turns"),
        F.transform("m", lambda m: F.struct(m["begin"].alias("begin"), m["learned"].alias("length"))).alias("loss"),
        F.transform("m", lambda m: F.length(m["stretch"])).alias("lengths"), media.alias("attachments"),
        F.aggregate(media, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"))


def stretches(formatted: Column) -> Column:
    """The formatted text cut after each end mark; control strings can't be in a message, so this is exact."""
    return F.filter(F.split(formatted, r"(?<=<\|im_end\|>\n)"), lambda s: s != "")


def read_back(stretch: Column) -> Column:
    """(role, text) of one stretch, unescaped. Placeholders stay as they are."""
    inner = F.substr(stretch, F.lit(len(START) + 1), F.length(stretch) - (len(START) + len(END) + 1))
    at = F.instr(inner, "\n")
    return F.struct(unescaped(F.replace(F.substr(inner, F.lit(1), at - 1), F.lit(LINE), F.lit("\n"))).alias("role"),
                    unescaped(F.substr(inner, at + 1)).alias("text"))


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order with nothing between."""
    return F.array_join(F.zip_with(stretches(formatted), loss, lambda s, w: unescaped(F.substr(s, w["begin"], w["length"]))), "")
