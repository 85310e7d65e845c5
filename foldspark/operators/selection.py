"""Choosing among candidate models by what was known before each fold's test.

``scores`` has (candidate, outer_fold_id, score, known_at, test_start) with smaller
scores better; a fold's own score and scores not known yet never count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recent(scores: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """(fold, candidate, score, n): mean of the ``k`` latest scores known before each fold's test."""
    keys = [*by, "candidate"]
    now = scores.select(*keys, "outer_fold_id", "test_start").distinct()
    past = scores.select(*(F.col(c).alias(f"_{c}") for c in keys), F.col("outer_fold_id").alias("_fold"), F.col("score").alias("_score"), "known_at")
    same = F.lit(True)
    for c in keys:
        same = same & (F.col(c) == F.col(f"_{c}"))
    joined = now.join(past, same & (F.col("known_at") < F.col("test_start")) & F.col("_score").isNotNull())
    latest = Window.partitionBy(*keys, "outer_fold_id").orderBy(F.desc("_fold"))
    used = joined.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= k)
    return used.groupBy("outer_fold_id", *keys).agg(F.avg("_score").alias("score"), F.count(F.lit(1)).alias("n_folds"))


def _ranked(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    order = Window.partitionBy("outer_fold_id", *by).orderBy(F.round("score", 12), "candidate")
    out = scored.withColumn("rank", F.row_number().over(order))
    return out.withColumn("chosen", F.col("rank") == 1).withColumn("weight", (F.col("rank") == 1).cast("double"))


def best_recent(scores: DataFrame, k: int = 2) -> DataFrame:
    """The candidate with the smallest recent score; the comparison table is all rows."""
    return _ranked(recent(scores, k), [])


def blend_weights(scores: DataFrame, k: int = 2) -> DataFrame:
    """Weights in proportion to 1 / recent score; candidates without any error share all weight."""
    out = _ranked(recent(scores, k), [])
    fold = Window.partitionBy("outer_fold_id")
    perfect = F.sum((F.col("score") <= 0).cast("double")).over(fold)
    share = F.when(perfect > 0, (F.col("score") <= 0).cast("double")).otherwise(F.try_divide(F.lit(1.0), F.col("score")))
    return out.withColumn("weight", F.try_divide(share, F.sum(share).over(fold)))


def diagnostic_aware(scores: DataFrame, penalties: DataFrame, strength: float = 1.0, k: int = 2) -> DataFrame:
    """Recent score plus ``strength`` times the candidate's recent ``penalty`` (candidate, outer_fold_id, penalty, known_at, test_start)."""
    base = recent(scores, k)
    extra = recent(penalties.withColumnRenamed("penalty", "score"), k).select("outer_fold_id", "candidate", F.col("score").alias("penalty"))
    both = base.join(extra, ["outer_fold_id", "candidate"], "left")
    return _ranked(both.withColumn("score", F.col("score") + strength * F.coalesce("penalty", F.lit(0.0))), [])


def by_regime(scores: DataFrame, k: int = 2) -> DataFrame:
    """The best candidate for each regime (a column of ``scores``)."""
    return _ranked(recent(scores, k, ["regime"]), ["regime"])


def apply_weights(candidates: DataFrame, weights: DataFrame) -> DataFrame:
    """Predictions blended by (outer_fold_id, candidate, weight): chosen ones if the weights are 0 and 1."""
    both = candidates.join(weights.filter("weight > 0").select("outer_fold_id", "candidate", "weight"), ["outer_fold_id", "candidate"])
    return both.groupBy("outer_fold_id", "asset", "bar_ts").agg(F.max("y").alias("y"), F.try_divide(F.sum(F.col("weight") * F.col("pred")), F.sum("weight")).alias("pred"))
