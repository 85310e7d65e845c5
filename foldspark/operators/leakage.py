"""Checks that nothing uses what it cannot know."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LeakageError(AssertionError):
    """A table breaks a rule of walk-forward validation."""


def check_purged(assigned: DataFrame) -> None:
    """No training label may end at or after the test's start."""
    bad = assigned.filter((F.col("split_role") == "train") & (F.col("label_end_idx") >= F.col("test_start")))
    if not bad.isEmpty():
        raise LeakageError(f"a training label reaches into the test: {bad.first()}")


def check_fitted(assigned: DataFrame, keys: Sequence[str]) -> None:
    """In the scope that statistics are fitted in, every training row and its label must be over, on the
    clock that all assets share (``clock``, ``clock_end``), before the first row they are applied to."""
    known = F.greatest(F.col("clock"), F.coalesce("clock_end", "clock"))
    spans = assigned.groupBy(*keys).agg(F.max(F.when(F.col("split_role") == "train", known)).alias("last"), F.min(F.when(F.col("split_role") == "test", F.col("clock"))).alias("first"))
    bad = spans.filter("last >= first")
    if not bad.isEmpty():
        raise LeakageError(f"statistics of {list(keys)} use rows at or after a row they are applied to: {bad.first()}")


def check_coverage(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> None:
    """Each expected row is predicted exactly once."""
    missing = expected.join(predicted, keys, "left_anti")
    if not missing.isEmpty():
        raise LeakageError(f"no prediction for {missing.select(*keys).first()}")
    twice = predicted.groupBy(*keys).count().filter("count > 1")
    if not twice.isEmpty():
        raise LeakageError(f"predicted more than once: {twice.first()}")


def causal(bars: DataFrame, make: Callable[[DataFrame], DataFrame], t: int) -> None:
    """What ``make`` gives up to time ``t`` must not change if all later bars do."""
    later = F.col("t_idx") > t
    changed = bars.withColumns({c: F.when(later, F.col(c) * 3 + 1).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    times = bars.filter(~later).select("asset", "bar_ts")
    a, b = (make(x).join(times, ["asset", "bar_ts"], "left_semi") for x in (bars, changed))
    if not a.exceptAll(b).isEmpty():
        raise LeakageError(f"a value up to time {t} depends on later bars")


def check_no_target_copy(features: DataFrame, target: DataFrame, names: list[str]) -> None:
    """No feature may equal the row's target."""
    both = features.join(target.select("asset", "bar_ts", "y"), ["asset", "bar_ts"]).filter("y is not null")
    same = both.agg(*(F.avg(F.when(F.col(f).isNotNull(), (F.abs(F.col(f) - F.col("y")) < 1e-12).cast("double"))).alias(f) for f in names)).first()
    for f in names:
        if same[f] is not None and same[f] > 0.99:
            raise LeakageError(f"feature {f} is a copy of the target")
