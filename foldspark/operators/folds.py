"""Walk-forward fold plans, and which rows a fold trains and tests on.

Sizes, gaps and starts count places on the shared time index.  A plan is a small
table: a row for each fold, made from one row with the number of times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLD = ["outer_fold_id", "train_start", "train_end", "test_start", "test_end"]


@dataclass(frozen=True)
class ValidationSpec:
    """How time is split; a fold tests on the ``test_size`` times after those of the last."""

    split_type: str = "expanding"
    min_train_size: int = 300
    test_size: int = 100
    embargo: int = 20
    rolling_train_size: int | None = None
    mode: str = "pooled"

    def __post_init__(self) -> None:
        if self.split_type not in ("expanding", "rolling") or self.mode not in ("pooled", "per_asset"):
            raise ValueError(f"no such validation: {self.split_type}, {self.mode}")
        if self.split_type == "rolling" and not self.rolling_train_size:
            raise ValueError("a rolling split needs rolling_train_size")
        if min(self.min_train_size, self.test_size) < 1 or self.embargo < 0:
            raise ValueError("sizes are positive, an embargo is not negative")


def _plan(spans: DataFrame, spec: ValidationSpec, gap: int, low: Column, high: Column, fold: str) -> DataFrame:
    """Adds ``fold`` and bounds of train and test inside [low, high) to each row of ``spans``."""
    first = low + spec.min_train_size + gap
    starts = F.when(first < high, F.sequence(first, high - 1, F.lit(spec.test_size))).otherwise(F.array().cast("array<int>"))
    rows = spans.select("*", F.posexplode(starts).alias(fold, "_s"))
    end = F.col("_s") - gap
    start = F.greatest(low, end - spec.rolling_train_size) if spec.split_type == "rolling" else low
    return rows.select(
        *spans.columns,
        fold,
        start.cast("int").alias("_train_start"),
        end.cast("int").alias("_train_end"),
        F.col("_s").cast("int").alias("_test_start"),
        F.least(F.col("_s") + spec.test_size, high).cast("int").alias("_test_end"),
    )


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({f"_{c}": c for c in FOLD[1:]})


def outer_folds(panel: DataFrame, spec: ValidationSpec, gap: int | None = None) -> DataFrame:
    """Folds over the times of ``panel``; in per-asset mode a plan for each asset on its own index."""
    gap = spec.embargo if gap is None else max(gap, spec.embargo)
    if spec.mode == "per_asset":
        spans = panel.groupBy("asset").agg(F.count(F.lit(1)).cast("int").alias("_n"))
    else:
        spans = panel.agg((F.max("t_idx") + 1).cast("int").alias("_n"))
    return _named(_plan(spans, spec, gap, F.lit(0), F.col("_n"), "outer_fold_id").drop("_n"))


def inner_folds(outer: DataFrame, spec: ValidationSpec, gap: int | None = None) -> DataFrame:
    """For each outer fold a plan inside its training span."""
    gap = spec.embargo if gap is None else max(gap, spec.embargo)
    keys = [c for c in ("asset", "outer_fold_id") if c in outer.columns]
    spans = outer.select(*keys, F.col("train_start").alias("_low"), F.col("train_end").alias("_high"))
    return _named(_plan(spans, spec, gap, F.col("_low"), F.col("_high"), "inner_fold_id").drop("_low", "_high"))


def scope(plan: DataFrame) -> list[str]:
    """What a statistic of this plan is fitted by: its folds, and the asset where each asset has folds of its own."""
    return [c for c in ("asset", "outer_fold_id", "inner_fold_id") if c in plan.columns]


def eligible(gap: int, t: str = "t_idx", end: str = "label_end_idx") -> Column:
    """A row may train a fold if this is before the fold's test start: embargo and purge in one number."""
    return F.greatest(F.col(t) + gap, F.col(end))


def in_train(gap: int) -> Column:
    return (F.col("t_idx") >= F.col("train_start")) & (eligible(gap) < F.col("test_start"))


def in_test() -> Column:
    return (F.col("t_idx") >= F.col("test_start")) & (F.col("t_idx") < F.col("test_end"))


#: Folds up to which a plan is broadcast (about 64 bytes each, or a kilobyte with a model's coefficients).
BROADCAST_FOLDS = 10_000
#: Times of a bucket by which rows meet the spans of larger plans.
BUCKET = 64


def few(plan: DataFrame) -> bool:
    """Whether a plan is counted to be small, as inner plans grow with the square of the times; plans by asset count as large."""
    return "asset" not in plan.columns and plan.limit(BROADCAST_FOLDS + 1).count() <= BROADCAST_FOLDS


def bounded(folds: DataFrame, plan: DataFrame | None = None) -> DataFrame:
    """``folds`` to be broadcast, if they are few. ``plan`` has as many rows and is counted in their place where they take longer to compute."""
    return F.broadcast(folds) if few(folds if plan is None else plan) else folds


def meet(rows: DataFrame, spans: DataFrame, low: str, high: str, plan: DataFrame | None = None, on: Sequence[str] = ("asset",)) -> DataFrame:
    """``rows`` by the ``spans`` with low <= t_idx < high, of the same ``on`` where spans have it.

    Few spans are broadcast.  Others are laid out by buckets of ``BUCKET`` times, so rows meet those of their bucket
    by an equal key and not all spans; what is shuffled follows the result, which has a row for each of them anyway.
    """
    inside = (F.col("t_idx") >= F.col(low)) & (F.col("t_idx") < F.col(high))
    keys = [k for k in on if k in spans.columns and k in rows.columns]
    if not keys and few(spans if plan is None else plan):
        return rows.join(F.broadcast(spans), inside)
    buckets = F.sequence(F.floor(F.col(low) / BUCKET), F.floor((F.col(high) - 1) / BUCKET))
    laid = spans.filter(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(buckets))
    return rows.withColumn("_bucket", F.floor(F.col("t_idx") / BUCKET)).join(laid, [*keys, "_bucket"]).filter(inside).drop("_bucket")


def assign(rows: DataFrame, folds: DataFrame, gap: int) -> DataFrame:
    """A row for each row and fold whose span holds it, with its role: train, test, or
    embargo (between both, or with a label that reaches into the test)."""
    role = F.when(in_test(), "test").when(in_train(gap), "train").otherwise("embargo")
    return meet(rows, folds, "train_start", "test_end").withColumn("split_role", role)
