"""Transforms fitted on each fold's training rows and applied to its other rows.

Every function takes rows with ``split_role`` and fold columns, as
:func:`foldspark.operators.folds.assign` gives them.  ``keys`` are the scope that
statistics are fitted in: the fold, and the asset too where each asset has a plan of its
own (:func:`foldspark.operators.folds.scope`).  Fitted statistics are a row a scope,
so they are joined by its keys and Spark broadcasts them by their size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators import order


def fold_keys(rows: DataFrame) -> list[str]:
    return [c for c in ("outer_fold_id", "inner_fold_id") if c in rows.columns]


def train_only(value: Column | str) -> Column:
    return F.when(F.col("split_role") == "train", F.col(value) if isinstance(value, str) else value)


def standardise(rows: DataFrame, features: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """(x - training mean) / training standard deviation; NULL where that is 0."""
    keys = list(keys or fold_keys(rows))
    stats = [g(train_only(f)).alias(f"_{n}_{f}") for f in features for n, g in (("m", F.avg), ("s", F.stddev_samp))]
    joined = rows.join(rows.groupBy(*keys).agg(*stats), keys)
    scaled = {f: F.try_divide(F.col(f) - F.col(f"_m_{f}"), F.col(f"_s_{f}")) for f in features}
    return joined.withColumns(scaled).drop(*(f"_{n}_{f}" for f in features for n in "ms"))


def winsorise(rows: DataFrame, features: Sequence[str], low: float = 0.01, high: float = 0.99, keys: Sequence[str] | None = None) -> DataFrame:
    """Clipped to the training quantiles."""
    keys = list(keys or fold_keys(rows))
    long = rows.filter(F.col("split_role") == "train").unpivot(keys, list(features), "feature", "_x")
    cuts = order.quantiles(long, [*keys, "feature"], "_x", [low, high], "_q")
    wide = cuts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("feature", "_q"))).alias("_cuts"))
    of = lambda f: F.col("_cuts")[f]
    clipped = {f: F.when(F.col(f).isNotNull(), F.least(F.greatest(F.col(f), of(f)[0]), of(f)[1])) for f in features}
    return rows.join(wide, keys, "left").withColumns(clipped).drop("_cuts")


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation of the rows where both are there; NULL for constants and under 3 rows.

    In moments, so that it partly aggregates and never divides by zero.
    """
    has = a.isNotNull() & b.isNotNull()
    x, y = F.when(has, a), F.when(has, b)
    n = F.count(x)
    vx, vy = F.var_pop(x), F.var_pop(y)
    return F.when((n >= 3) & (vx > 1e-300) & (vy > 1e-300), F.try_divide(F.covar_pop(x, y), F.sqrt(vx) * F.sqrt(vy)))


def top_correlated(rows: DataFrame, features: Sequence[str], k: int, y: str = "y", keys: Sequence[str] | None = None) -> DataFrame:
    """(fold, feature, corr, rank): the ``k`` features that correlate most with the target in training."""
    keys = list(keys or fold_keys(rows))
    wide = rows.filter(F.col("split_role") == "train").groupBy(*keys).agg(*(safe_corr(F.col(f), F.col(y)).alias(f) for f in features))
    long = wide.unpivot(keys, list(features), "feature", "corr").filter("corr is not null")
    by = Window.partitionBy(*keys).orderBy(F.desc(F.round(F.abs("corr"), 9)), "feature")
    return long.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)


def components(rows: DataFrame, features: Sequence[str], k: int, keys: Sequence[str] | None = None) -> DataFrame:
    """(fold, component, feature, loading, variance) of the ``k`` first principal components
    of standardised training rows, from the fold's correlations. The largest loading is positive."""
    import numpy as np
    import pandas as pd

    keys = list(keys or fold_keys(rows))
    train = rows.filter(F.col("split_role") == "train").dropna(subset=list(features))
    pairs = [safe_corr(F.col(a), F.col(b)).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if j > i]
    corr = train.groupBy(*keys).agg(*pairs)

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                m = np.eye(len(features))
                for i in range(len(features)):
                    for j in range(i + 1, len(features)):
                        v = row[f"c{i}_{j}"]
                        m[i, j] = m[j, i] = 0.0 if v is None or v != v else v
                value, vector = np.linalg.eigh(m)
                for c in range(k):
                    v = vector[:, -1 - c]
                    v = v * np.sign(v[np.abs(v).argmax()])
                    out += [[*(row[x] for x in keys), c, f, float(x), float(value[-1 - c])] for f, x in zip(features, v)]
            yield pd.DataFrame(out, columns=[*keys, "component", "feature", "loading", "variance"])

    kinds = [f"{x} {corr.schema[x].dataType.simpleString()}" for x in keys]
    return corr.mapInPandas(run, ", ".join([*kinds, "component int, feature string, loading double, variance double"]))


def project(rows: DataFrame, loadings: DataFrame, features: Sequence[str], k: int, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows with ``pc0`` to ``pc{k-1}``, of standardised inputs."""
    keys = list(keys or fold_keys(rows))
    z = standardise(rows, features, keys)
    wide = loadings.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "component", "feature"), "loading"))).alias("_l"))
    joined = z.join(wide, keys)
    made = {f"pc{c}": sum((F.col("_l")[f"{c}:{f}"] * F.col(f) for f in features), F.lit(0.0)) for c in range(k)}
    return joined.withColumns(made).drop("_l", *features)
