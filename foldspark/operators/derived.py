"""Row-level features from predictions, delayed until their labels are known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.features import by_asset


def _matured(value: Column, horizon: int, n: int, what) -> Column:
    """An aggregate of the ``n`` last values whose labels ended ``horizon`` bars ago; NULL under 2."""
    frame = by_asset().rowsBetween(-(horizon + n - 1), -horizon)
    return F.when(F.count(value).over(frame) >= 2, what(value).over(frame))


def residual_std(preds: DataFrame, horizon: int, n: int = 20) -> DataFrame:
    """Trailing deviation of the asset's residuals. ``preds`` has one row for each bar."""
    return preds.select("asset", "bar_ts", _matured(F.col("y") - F.col("pred"), horizon, n, F.stddev_samp).alias("resid_std"))


def model_health(preds: DataFrame, horizon: int, n: int = 20) -> DataFrame:
    """Trailing mean of the asset's absolute errors."""
    return preds.select("asset", "bar_ts", _matured(F.abs(F.col("y") - F.col("pred")), horizon, n, F.avg).alias("health"))


def disagreement(candidates: DataFrame) -> DataFrame:
    """Spread of the candidates' predictions of a bar; known when they are made."""
    return candidates.groupBy("asset", "bar_ts", "outer_fold_id").agg(F.stddev_pop("pred").alias("disagreement"), (F.max("pred") - F.min("pred")).alias("pred_range"))
