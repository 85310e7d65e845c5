"""Diagnostics: fold-level tables (fold, [asset, feature], metric, value, known_at).

They are made by DiagnosticNodes from predictions and assigned rows.  ``known_at`` is
the last time a label used was known; nothing may use a value at or before it.
``keys`` are the scope, as for the transforms: the fold, and the asset of plans by asset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators import order
from foldspark.operators.lineage import cut
from foldspark.operators.transforms import fold_keys, safe_corr, train_only

EPS = 1e-4


def _test(value: Column) -> Column:
    return F.when(F.col("split_role") == "test", value)


def known_at() -> Column:
    return F.max("label_end_idx").alias("known_at")


def squared_error() -> Column:
    return (F.col("y") - F.col("pred")) * (F.col("y") - F.col("pred"))


def log_loss(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(F.col("y") * F.ln(q) + (1 - F.col("y")) * F.ln(1 - q))


#: Losses of a row by name; smaller is better. ``rmse`` is the root of the mean of squared errors.
LOSSES = {
    "mse": squared_error,
    "rmse": squared_error,
    "mae": lambda: F.abs(F.col("y") - F.col("pred")),
    "brier": squared_error,
    "log_loss": lambda: log_loss(F.col("pred")),
    "miss_rate": lambda: (F.signum("y") != F.signum("pred")).cast("double"),
}


def mean_loss(metric: str) -> Column:
    """An aggregate of rows with y and pred."""
    if metric not in LOSSES:
        raise ValueError(f"no loss {metric}; known: {sorted(LOSSES)}")
    mean = F.avg(LOSSES[metric]())
    return F.sqrt(mean) if metric == "rmse" else mean


def deviance_gap(scored: DataFrame, task_type: str = "regression", keys: Sequence[str] | None = None) -> DataFrame:
    """Test deviance less training deviance: mean squared error, or twice the mean log loss."""
    loss = squared_error() if task_type == "regression" else 2 * log_loss(F.col("pred"))
    gap = F.avg(_test(loss)) - F.avg(train_only(loss))
    return scored.groupBy(*(keys or fold_keys(scored))).agg(gap.alias("value"), known_at()).withColumn("metric", F.lit("train_test_deviance_gap"))


def drift_moments(rows: DataFrame, features: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Shift of the mean in training deviations, and the ratio of deviations."""
    keys = list(keys or fold_keys(rows))
    long = rows.unpivot([*keys, "split_role"], list(features), "feature", "x")
    x = F.col("x")
    stats = long.groupBy(*keys, "feature").agg(
        F.avg(train_only(x)).alias("m1"), F.stddev_samp(train_only(x)).alias("s1"), F.avg(_test(x)).alias("m2"), F.stddev_samp(_test(x)).alias("s2")
    )
    return stats.select(*keys, "feature", F.try_divide(F.col("m2") - F.col("m1"), F.col("s1")).alias("mean_shift"), F.try_divide("s2", "s1").alias("std_ratio"))


def drift_quantiles(rows: DataFrame, features: Sequence[str], at: Sequence[float] = (0.1, 0.5, 0.9), keys: Sequence[str] | None = None) -> DataFrame:
    """Differences of quantiles in training deviations."""
    keys = list(keys or fold_keys(rows))
    long = rows.unpivot([*keys, "split_role"], list(features), "feature", "x")
    cuts = order.quantiles(long.filter("split_role in ('train', 'test')"), [*keys, "feature", "split_role"], "x", at, "q")
    both = cuts.groupBy(*keys, "feature").agg(F.max(train_only("q")).alias("q1"), F.max(_test(F.col("q"))).alias("q2"))
    stats = long.groupBy(*keys, "feature").agg(F.stddev_samp(train_only("x")).alias("s1")).join(both, [*keys, "feature"], "left")
    shifts = [F.try_divide(F.col("q2")[i] - F.col("q1")[i], F.col("s1")).alias(f"shift_{round(100 * p)}") for i, p in enumerate(at)]
    return stats.select(*keys, "feature", *shifts)


def psi(rows: DataFrame, features: Sequence[str], bins: int = 10, keys: Sequence[str] | None = None) -> DataFrame:
    """Population stability: training quantile bins, shares floored at ``EPS``."""
    keys = list(keys or fold_keys(rows))
    long = rows.unpivot([*keys, "split_role"], list(features), "feature", "x").filter("x is not null")
    edges = order.quantiles(long.filter("split_role = 'train'"), [*keys, "feature"], "x", [i / bins for i in range(1, bins)], "edges")
    binned = long.join(edges, [*keys, "feature"], "left").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("x"))))
    counts = binned.groupBy(*keys, "feature", "bin").agg(F.count(train_only("x")).alias("a"), F.count(_test(F.col("x"))).alias("b"))
    every = counts.groupBy(*keys, "feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"), F.map_from_entries(F.collect_list(F.struct("bin", F.struct("a", "b")))).alias("by"))
    p = lambda i, s: F.greatest(F.try_divide(F.coalesce(F.col("by")[i][s], F.lit(0)), F.col(f"n{s}")), F.lit(EPS))
    total = sum(((p(i, "b") - p(i, "a")) * F.ln(p(i, "b") / p(i, "a")) for i in range(bins)), F.lit(0.0))
    return every.select(*keys, "feature", total.alias("psi"))


def drift_correlation(rows: DataFrame, features: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Mean absolute change of the correlations between features."""
    keys = list(keys or fold_keys(rows))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    changes = [F.abs(safe_corr(_test(F.col(a)), _test(F.col(b))) - safe_corr(train_only(a), train_only(b))).alias(f"d{i}") for i, (a, b) in enumerate(pairs)]
    wide = rows.groupBy(*keys).agg(*changes)
    long = wide.unpivot(keys, [f"d{i}" for i in range(len(pairs))], "pair", "change")
    return long.groupBy(*keys).agg(F.avg("change").alias("corr_change"))


def residual_std(scored: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Standard deviation of residuals of each fold and asset."""
    keys = [k for k in keys or fold_keys(scored) if k != "asset"]
    return scored.groupBy(*keys, "asset").agg(F.stddev_samp(F.col("y") - F.col("pred")).alias("value"), F.count(F.col("y") - F.col("pred")).alias("n"), known_at())


def disagreement(scored: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Of candidates' predictions of the same rows: mean spread, and one less the mean over
    candidates of their correlation with the row's mean prediction (NULL if all are constant)."""
    keys = list(keys or fold_keys(scored))
    by = Window.partitionBy(*dict.fromkeys([*keys, "asset", "bar_ts"]))
    rows = scored.withColumns({"mean": F.avg("pred").over(by), "spread": F.stddev_pop("pred").over(by), "n": F.count("pred").over(by)}).filter("n > 1 and pred is not null")
    each = rows.groupBy(*keys, "candidate").agg(safe_corr(F.col("pred"), F.col("mean")).alias("corr"), F.sum(F.col("spread") / F.col("n")).alias("spread"), F.sum(1 / F.col("n")).alias("rows"))
    return each.groupBy(*keys).agg((F.sum("spread") / F.sum("rows")).alias("value"), (1 - F.avg("corr")).alias("one_less_corr"), F.round(F.sum("rows")).cast("long").alias("n_rows"))


def coefficient_stability(coefs: DataFrame) -> DataFrame:
    """(fold, change, sign_flips, mean_std) of long coefficients: distance to the last fold's, share of
    changed signs, and the mean over coefficients of their standard deviation over the folds so far."""
    by = [c for c in ("asset",) if c in coefs.columns]
    order = Window.partitionBy(*by, "feature").orderBy("outer_fold_id")
    steps = coefs.filter("feature <> 'intercept'").withColumn("last", F.lag("coef").over(order)).withColumn("std", F.stddev_samp("coef").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = F.col("coef") - F.col("last")
    return steps.filter("last is not null").groupBy(*by, "outer_fold_id").agg(
        F.sqrt(F.sum(d * d)).alias("change"), F.avg((F.signum("coef") != F.signum("last")).cast("double")).alias("sign_flips"), F.avg("std").alias("mean_std")
    )


def coefficient_spread(coefs: DataFrame) -> DataFrame:
    """([asset,] feature, n_folds, mean, std) of each coefficient over all folds."""
    by = [c for c in ("asset",) if c in coefs.columns]
    return coefs.groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n_folds"), F.avg("coef").alias("mean"), F.stddev_samp("coef").alias("std"))


def calibration_gap(scored: DataFrame, bins: int = 10, keys: Sequence[str] | None = None) -> DataFrame:
    """Expected calibration error of probabilities in ``pred``, in bins of equal width."""
    keys = list(keys or fold_keys(scored))
    at = F.least(F.floor(F.col("pred") * bins), F.lit(bins - 1)).cast("int")
    by = scored.filter("y is not null and pred is not null").withColumn("bin", at).groupBy(*keys, "bin")
    rows = by.agg(F.count(F.lit(1)).alias("n"), F.avg("pred").alias("p"), F.avg("y").alias("m"))
    return rows.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("m"))) / F.sum("n")).alias("value"))


def regression_calibration_gap(scored: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    keys = list(keys or fold_keys(scored))
    return scored.filter("y is not null and pred is not null").groupBy(*keys).agg(F.abs(F.avg("pred") - F.avg("y")).alias("value"))


def regression_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, rmse, mae, r2, Pearson ic and hit rate of each group."""
    used = scored.filter("y is not null and pred is not null")
    e = F.col("y") - F.col("pred")
    return used.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop("y"))).alias("r2"),
        safe_corr(F.col("y"), F.col("pred")).alias("ic"),
        F.avg((F.signum("y") == F.signum("pred")).cast("double")).alias("hit_rate"),
    )


def rank_ic(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spearman correlation: Pearson of average ranks."""
    used = scored.filter("y is not null and pred is not null").select(*by, "y", "pred")
    ranked = order.average_ranks(order.average_ranks(used, by, "y", "_a"), by, "pred", "_b")
    return ranked.groupBy(*by).agg(safe_corr(F.col("_a"), F.col("_b")).alias("rank_ic"))


def classification_metrics(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, log loss, Brier score, accuracy at one half, and AUC by average ranks."""
    used = scored.filter("y is not null and pred is not null").select(*by, "y", "pred")
    ranked = order.average_ranks(used, by, "pred", "_r")
    n1, n0 = F.sum("y"), F.sum(1 - F.col("y"))
    return ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(log_loss(F.col("pred"))).alias("log_loss"),
        F.avg(squared_error()).alias("brier"),
        F.avg(((F.col("pred") >= 0.5).cast("double") == F.col("y")).cast("double")).alias("accuracy"),
        F.try_divide(F.sum(F.when(F.col("y") == 1, F.col("_r"))) - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"),
    )


def residual_profile(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Bias, tails and the correlation of a residual with the asset's last one."""
    e = F.col("y") - F.col("pred")
    rows = scored.filter("y is not null and pred is not null").withColumn("e", e)
    rows = rows.withColumn("e1", F.lag("e").over(Window.partitionBy(*by, "asset").orderBy("bar_ts")))
    rows = cut(rows.select(*dict.fromkeys([*by, "e", "e1"])))
    tails = order.quantiles(rows, by, "e", [0.05, 0.95], "_q")
    means = rows.groupBy(*by).agg(F.avg("e").alias("bias"), safe_corr(F.col("e"), F.col("e1")).alias("autocorr"))
    return means.join(tails, list(by)).select(*by, "bias", F.col("_q")[0].alias("q05"), F.col("_q")[1].alias("q95"), "autocorr")
