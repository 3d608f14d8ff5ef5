"""Terms that more items mention than a while before."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from digestry.functions import text as X


def emerging_terms(items: DataFrame, hours: int = 24, least: int = 1) -> DataFrame:
    """(period, term, n, before): title terms that n items of a period mention, more than in the period before.

    Periods are whole stretches of `hours` since 1970. All terms are counted, each once per item and summed up before
    the shuffle; a term without mention in the period before has `before` 0. Items without a time are left out.
    """
    period = F.floor(F.unix_timestamp("published_at") / (hours * 3600)).cast("bigint")
    said = (items.where(F.col("published_at").isNotNull())
            .select(period.alias("period"), F.explode(X.title_tokens(F.col("title"))).alias("term")))
    counted = said.groupBy("period", "term").agg(F.count("*").alias("n"))
    by_time = Window.partitionBy("term").orderBy("period")
    last = F.when(F.lag("period").over(by_time) == F.col("period") - 1, F.lag("n").over(by_time))
    return (counted.withColumn("before", F.coalesce(last, F.lit(0).cast("bigint")))
            .where((F.col("n") > F.col("before")) & (F.col("n") >= least)))
