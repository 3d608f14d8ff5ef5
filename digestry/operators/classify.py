"""Topical domain of items by keyword counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text as X
from digestry.settings import Settings


def domain_of(text: Column, allowed: Column, s: Settings) -> Column:
    """Allowed domain with the most keywords in the lower-cased text.

    The earliest configured domain wins ties; without any hit it is the first allowed one. Counts are column
    expressions over the configured words, so classification stays inside the scan's stage.
    """
    # Compared by hits, then by place: the first allowed domain beats all others without hits.
    candidates = [F.struct(F.lit(0).alias("hits"), F.lit(1).alias("place"), F.get(allowed, F.lit(0)).alias("domain"))]
    for i, (domain, words) in enumerate(s.domain_keywords):
        hits = F.when(F.array_contains(allowed, domain), X.keyword_hits(text, words)).otherwise(0)
        candidates.append(F.struct(F.coalesce(hits, F.lit(0)).alias("hits"), F.lit(-i).alias("place"),
                                   F.lit(domain).alias("domain")))
    return F.array_max(F.array(*candidates))["domain"]


def classify(items: DataFrame, s: Settings, allowed: str = "domains") -> DataFrame:
    """Set `domain` from title and description. Rows whose list of allowed domains is empty are dropped."""
    text = X.searchable(F.col("title"), F.col("description"))
    return (items.where(F.size(F.col(allowed)) > 0)
            .withColumn("domain", domain_of(text, F.col(allowed), s)))
