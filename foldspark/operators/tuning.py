"""Nested tuning and out-of-fold predictions of ridge, all folds at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators import diagnostics, ridge
from foldspark.operators.folds import ValidationSpec, inner_folds


def inner_scores(rows: DataFrame, outer: DataFrame, spec: ValidationSpec, features: Sequence[str], alphas: Sequence[float], y: str = "y", gap: int = 20) -> DataFrame:
    """(outer, inner, alpha, n_test, mse): every candidate on every inner fold, from sums."""
    inner = inner_folds(outer, spec, gap)
    keys = [c for c in ("asset", "outer_fold_id", "inner_fold_id") if c in inner.columns]
    made = ridge.cells(rows, features, y, gap, ["asset"] if "asset" in keys else [])
    fits = ridge.solve(ridge.fold_sums(made, inner), features, alphas, keys)
    return ridge.losses(ridge.fold_sums(made, inner, "test"), fits, features, keys)


def best(scores: DataFrame) -> DataFrame:
    """(outer, alpha, mse, n_inner, rank): candidates by their mean over inner folds; ties to the larger penalty."""
    keys = [c for c in ("asset", "outer_fold_id") if c in scores.columns]
    mean = scores.groupBy(*keys, "alpha").agg(F.avg("mse").alias("mse"), F.count(F.lit(1)).alias("n_inner"))
    return mean.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("mse", 12), F.desc("alpha"))))


def fit_candidates(rows: DataFrame, folds: DataFrame, features: Sequence[str], candidates: Sequence[Mapping[str, Any]], gap: int = 20) -> DataFrame:
    """Ridge fits of every candidate ({alpha, fit_intercept}) on every fold of a plan, with the column candidate."""
    keys = [c for c in ("asset", "outer_fold_id", "inner_fold_id") if c in folds.columns]
    made = ridge.cells(rows, features, "y", gap, ["asset"] if "asset" in keys else [])
    return solve_candidates(ridge.fold_sums(made, folds), features, candidates, keys)


def solve_candidates(sums: DataFrame, features: Sequence[str], candidates: Sequence[Mapping[str, Any]], keys: Sequence[str]) -> DataFrame:
    """The same from the folds' sums."""
    out = []
    for intercept in (True, False):
        own = {i: float(c.get("alpha", 1.0)) for i, c in enumerate(candidates) if bool(c.get("fit_intercept", True)) is intercept}
        if own:
            fits = ridge.solve(sums, features, sorted(set(own.values())), keys, intercept)
            numbers = F.array(*(F.struct(F.lit(i).alias("candidate"), F.lit(a).alias("a")) for i, a in own.items()))
            fits = fits.withColumn("_c", F.explode(numbers)).filter(F.col("_c.a") == F.col("alpha"))
            out.append(fits.withColumn("candidate", F.col("_c.candidate")).drop("_c"))
    return reduce(DataFrame.unionByName, out)


def grid(rows: DataFrame, outer: DataFrame, spec: ValidationSpec, features: Sequence[str], candidates: Sequence[Mapping[str, Any]], objective: str = "mse", gap: int = 20) -> DataFrame:
    """(outer, inner, candidate, n_test, score): every candidate on every inner fold.

    Squared errors come from sums; other losses need the inner tests' predictions.
    """
    inner = inner_folds(outer, spec, gap)
    keys = [c for c in ("asset", "outer_fold_id", "inner_fold_id") if c in inner.columns]
    fits = fit_candidates(rows, inner, features, candidates, gap)
    if objective in ("mse", "rmse"):
        made = ridge.cells(rows, features, "y", gap, ["asset"] if "asset" in keys else [])
        out = ridge.losses(ridge.fold_sums(made, inner, "test"), fits, features, keys, ["candidate"])
        return out.select(*keys, "candidate", "n_test", (F.sqrt("mse") if objective == "rmse" else F.col("mse")).alias("score"))
    return score_predictions(ridge.predict(rows, inner, fits, features), [*keys, "candidate"], objective)


def score_predictions(preds: DataFrame, keys: Sequence[str], objective: str) -> DataFrame:
    """(keys, n_test, score) of predictions that can be judged."""
    used = preds.filter("y is not null and pred is not null and label_end_idx is not null")
    return used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_test"), diagnostics.mean_loss(objective).alias("score"))


def best_candidates(scores: DataFrame) -> DataFrame:
    """(outer, candidate, score, n_inner): each fold's best by its mean over inner folds; ties to the first candidate."""
    keys = [c for c in ("asset", "outer_fold_id") if c in scores.columns]
    mean = scores.groupBy(*keys, "candidate").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_inner"))
    order = Window.partitionBy(*keys).orderBy(F.round("score", 12).asc_nulls_last(), "candidate")
    return mean.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def refit(rows: DataFrame, outer: DataFrame, ranked: DataFrame, features: Sequence[str], alphas: Sequence[float], gap: int = 20) -> DataFrame:
    """Fits on the whole outer training span with each fold's best penalty."""
    fits = ridge.fit(rows, outer, features, alphas=alphas, gap=gap)
    keys = [c for c in ("asset", "outer_fold_id") if c in fits.columns]
    return fits.join(ranked.filter("rank = 1").select(*keys, "alpha"), [*keys, "alpha"])


def out_of_fold(rows: DataFrame, outer: DataFrame, spec: ValidationSpec, features: Sequence[str], alpha: float = 1.0, gap: int = 20) -> DataFrame:
    """Training rows of each outer fold, predicted by inner models that did not see them.

    Rows before the first inner test have no such model and no row here.
    """
    inner = inner_folds(outer, spec, gap)
    fits = ridge.fit(rows, inner, features, alphas=[alpha], gap=gap)
    return ridge.predict(rows, inner, fits, features)
