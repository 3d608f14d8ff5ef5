"""Models learned from labels and reactions over the components of the score.

`learn_quality` estimates how likely an item is good, once there are enough labels. `learn_ranking` finds the weights of
the components under which readers' liked items come before their disliked ones. Both keep a part of what they are
given for measuring, the same part on every run, and score whole tables by built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from digestry.functions import text as X
from digestry.operators.feedback import latest_reactions
from digestry.operators.scoring import base_components
from digestry.session import settle
from digestry.settings import Settings

LEAST_LABELS = 50
HELD_OUT = 5        # one in so many is kept for measuring
PARTNERS = 4        # disliked items that a liked one meets, about, or the other way round where likes are fewer
REGULAR = 0.01

FEATURES = ("credibility", "length", "engagement", "relevance", "recency", "spam")


class TooFewLabels(ValueError):
    """There is not enough to learn from."""


def held_out(*ids: Column) -> Column:
    return F.pmod(F.xxhash64(*ids), F.lit(HELD_OUT)) == 0


def with_features(items: DataFrame, s: Settings, keep: Sequence[str]) -> DataFrame:
    """keep and the components of the score, as numbers. The text is put together once per row."""
    known = items.withColumn("_text", X.searchable(F.col("title"), F.col("description")))
    parts = base_components(s, F.col("_text"))
    return known.select(*keep, *[parts[f].cast("double").alias(f) for f in FEATURES])


@dataclass
class QualityModel:
    """auc: of labelled items that were not learned from; None if they are all of one kind."""

    model: PipelineModel
    columns: tuple[str, ...]
    labels: int
    auc: float | None

    def score(self, items: DataFrame, s: Settings, key: str = "item_id", vector: str | None = None) -> DataFrame:
        """(key, probability) of every item."""
        rows = _assembled(items, s, [key], self.columns, vector)
        return self.model.transform(rows).select(key, vector_to_array("probability")[1].alias("probability"))


def _assembled(items: DataFrame, s: Settings, keep: Sequence[str], columns: Sequence[str], vector: str | None) -> DataFrame:
    rows = with_features(items, s, [*keep, *([vector] if vector else [])])
    size = len(columns) - len(FEATURES)
    if not size:
        return rows
    # An item without a vector, or with one of another size, stands in the middle.
    known = F.coalesce(F.size(vector) == size, F.lit(False))
    return rows.select(*keep, *FEATURES, *[F.when(known, F.coalesce(F.get(vector, F.lit(i)).cast("double"), F.lit(0.0))).otherwise(0.0).alias(f"v{i}") for i in range(size)])


def learn_quality(items: DataFrame, labels: DataFrame, s: Settings, key: str = "item_id", label: str = "label", vector: str | None = None,
                  least: int = LEAST_LABELS) -> QualityModel:
    """Logistic regression of `label` (1 good, 0 not) on the components of the score, and on an embedding if named.

    labels holds (key, label), one row a key; null labels are left out. Raises TooFewLabels below `least` labelled
    items, or if those to learn from are all of one kind.
    """
    size = (items.agg(F.max(F.size(vector))).first()[0] or 0) if vector else 0
    columns = (*FEATURES, *(f"v{i}" for i in range(size)))
    known = labels.where(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
    rows = _assembled(items, s, [key], columns, vector).join(known, F.col(key) == F.col("_key")).drop("_key")
    rows = settle(rows.withColumn("_unseen", held_out(F.col(key))), "labelled")
    seen = {(r._unseen, r._label): r["count"] for r in rows.groupBy("_unseen", "_label").count().collect()}
    if sum(seen.values()) < least:
        raise TooFewLabels(f"{sum(seen.values())} labelled items, {least} are needed")
    if len({y for unseen, y in seen if not unseen}) < 2:
        raise TooFewLabels("all items to learn from have the same label")
    steps = [VectorAssembler(inputCols=list(columns), outputCol="_features"),
             LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="probability", rawPredictionCol="_raw", predictionCol="_guess", regParam=REGULAR)]
    model = Pipeline(stages=steps).fit(rows.where(~F.col("_unseen")))
    auc = None
    if len({y for unseen, y in seen if unseen}) == 2:
        auc = BinaryClassificationEvaluator(rawPredictionCol="_raw", labelCol="_label").evaluate(model.transform(rows.where("_unseen")))
    return QualityModel(model, columns, sum(seen.values()), auc)


@dataclass
class RankModel:
    """weights by component. right, right_additive: parts of unseen pairs that the learned and the additive score put in
    the readers' order, ties counting half; None without such pairs."""

    weights: dict[str, float]
    pairs: int
    unseen_pairs: int
    right: float | None
    right_additive: float | None

    def score(self, items: DataFrame, s: Settings, keep: Sequence[str] = ("item_id",)) -> DataFrame:
        """keep and `learned_score` of every item."""
        total = sum((F.col(f) * w for f, w in self.weights.items()), F.lit(0.0))
        return with_features(items, s, keep).select(*keep, total.alias("learned_score"))


def preference_pairs(reactions: DataFrame, per: Sequence[str] = ("user_id",), partners: int = PARTNERS) -> DataFrame:
    """(per, liked, disliked): pairs of items a reader likes and dislikes, each item of the larger kind in about
    `partners` of them. reactions: one row per reader and item.

    Items are dealt by hash into as many slots as leave `partners` of the smaller kind in each; pairs are those within
    a slot. So their number follows the number of reactions, and a reader with very many is spread over many slots.
    """
    likes = F.col("reaction") == "like"
    counts = reactions.groupBy(*per).agg(F.count_if(likes).alias("_likes"), F.count_if(~likes).alias("_others"))
    slots = counts.where("_likes > 0 and _others > 0").select(*per, F.ceil(F.least("_likes", "_others") / partners).alias("_slots"))
    dealt = reactions.select(*per, "item_id", likes.alias("_like")).join(slots, list(per)).withColumn("_slot", F.pmod(F.xxhash64("item_id"), F.col("_slots")))
    liked = dealt.where("_like").select(*per, "_slot", F.col("item_id").alias("liked"))
    return liked.join(dealt.where(~F.col("_like")).select(*per, "_slot", F.col("item_id").alias("disliked")), [*per, "_slot"]).drop("_slot")


def learn_ranking(reactions: DataFrame, items: DataFrame, s: Settings, per: Sequence[str] = ("user_id",), partners: int = PARTNERS,
                  least: int = LEAST_LABELS) -> RankModel:
    """Weights of the components by logistic regression on differences between a reader's liked and disliked items.

    A reader's latest reaction to an item counts; anything but a like is a dislike. Reactions that are held out meet
    each other only, and measure. Raises TooFewLabels below `least` pairs to learn from.
    """
    last = settle(latest_reactions(reactions.select(*per, "item_id", "event_ord", "reaction"), per).select(*per, "item_id", "reaction")
                  .withColumn("_unseen", held_out(*[F.col(p) for p in per], F.col("item_id"))), "reactions")
    features = settle(with_features(items, s, ["item_id"]), "features").select("item_id", F.array(*FEATURES).alias("_x"))
    pairs = preference_pairs(last, [*per, "_unseen"], partners)
    both = (pairs.join(features.toDF("liked", "_a"), "liked").join(features.toDF("disliked", "_b"), "disliked")
            .select("_unseen", F.xxhash64("liked", "disliked").alias("_h"), F.zip_with("_a", "_b", lambda a, b: a - b).alias("_d")))
    # Either item may come first, so that both labels occur; without an intercept it makes no difference.
    turned = F.when(F.col("_h") % 2 == 0, 1.0).otherwise(-1.0)
    rows = settle(both.select("_unseen", ((turned + 1) / 2).alias("_label"), turned.alias("_turn"), *[(F.col("_d")[i] * turned).alias(f) for i, f in enumerate(FEATURES)]), "differences")
    seen = rows.where(~F.col("_unseen"))
    n = seen.count()
    if n < least:
        raise TooFewLabels(f"{n} pairs, {least} are needed")
    model = LogisticRegression(featuresCol="_features", labelCol="_label", fitIntercept=False, standardization=False, regParam=REGULAR).fit(
        VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(seen))
    weights = dict(zip(FEATURES, (float(w) for w in model.coefficients)))

    def right(by: dict[str, float]) -> Column:
        gain = sum((F.col(f) * w for f, w in by.items()), F.lit(0.0)) * F.col("_turn")
        return F.avg(F.when(gain > 0, 1.0).when(gain == 0, 0.5).otherwise(0.0))

    additive = {f: -1.0 if f == "spam" else 1.0 for f in FEATURES}
    unseen = rows.where("_unseen").agg(F.count("*").alias("n"), right(weights).alias("learned"), right(additive).alias("additive")).first()
    return RankModel(weights, n, unseen.n, unseen.learned, unseen.additive)
