"""Quality score of items."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import scores as S
from digestry.functions import text as X
from digestry.settings import Settings


def base_components(s: Settings, text: Column | None = None) -> dict[str, Column]:
    """Rule components that need nothing but the item's own row. `text` is what keywords are looked for in."""
    text = X.searchable(F.col("title"), F.col("description")) if text is None else text
    return {
        "credibility": S.credibility(F.col("channel"), F.col("views"), s.whitelist),
        "length": S.length(F.col("kind"), F.col("duration"), F.col("description")),
        "engagement": S.engagement(F.col("kind"), F.col("authority"), F.col("likes"), F.col("comments")),
        "relevance": S.relevance(text, s.all_keywords),
        "recency": S.recency(F.col("published_at"), s.as_of),
        "spam": S.spam_penalty(text, s.spam_keywords),
    }


def with_preferences(items: DataFrame, source_weights: DataFrame | None, domain_weights: DataFrame | None,
                     per: Sequence[str] = ()) -> DataFrame:
    """Add `preference`, the learned adjustment.

    `per` names the columns that say whose weights apply, e.g. ("user_id",). Weights hold one row per key. No
    broadcast is forced: how many keys there are depends on the users, so Spark decides by size, and splits a
    hot channel of the item side when it has to sort-merge.
    """
    out = items.withColumn("_source_weight", F.lit(0.0)).withColumn("_domain_weight", F.lit(0.0))
    if source_weights is not None:
        w = source_weights.select(*per, F.col("channel"), F.col("weight").cast("double").alias("_source_weight"))
        out = out.drop("_source_weight").join(w, [*per, "channel"], "left")
    if domain_weights is not None:
        w = domain_weights.select(*per, F.col("domain"), F.col("weight").cast("double").alias("_domain_weight"))
        out = out.drop("_domain_weight").join(w, [*per, "domain"], "left")
    return (out.withColumn("preference", S.preference(F.col("_source_weight"), F.col("_domain_weight")))
            .drop("_source_weight", "_domain_weight"))


def score_items(items: DataFrame, s: Settings, source_weights: DataFrame | None = None,
                domain_weights: DataFrame | None = None, per: Sequence[str] = (),
                keep: Sequence[str] | None = None) -> DataFrame:
    """Add `quality_score`. `keep` limits the columns handed on, before anything is shuffled."""
    # The text is referred to many times; as a column of its own it is put together once per row.
    items = items.withColumn("_text", X.searchable(F.col("title"), F.col("description")))
    c = base_components(s, F.col("_text"))
    base = (c["credibility"] + c["length"] + c["engagement"] + c["relevance"] + c["recency"] - c["spam"])
    columns = list(keep) if keep is not None else [n for n in items.columns if n != "_text"]
    scored = items.select(*columns, base.cast("bigint").alias("_base"))
    scored = with_preferences(scored, source_weights, domain_weights, per)
    total = F.greatest(F.col("_base") + F.col("preference"), F.lit(0).cast("bigint"))
    return scored.select(*columns, total.alias("quality_score"))
