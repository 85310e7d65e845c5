"""Ridge regression by sums: one pass over the rows serves all folds and penalties.

Rows are added up by (time, eligibility) once.  A fold's sums are those of the cells
it may train on, so folds join cells, never rows, and a row is not copied for each
fold.  Each fold's small system is solved where its sums are.  The intercept is not
penalised.  Rows with a NULL in any input or target train nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators.folds import eligible, meet


def _moments(features: Sequence[str], y: str, origin: Sequence[float]) -> list:
    """Sums of inputs less an origin, as squares of large values would cancel; c0, c1, ... sum the origin itself."""
    x = [F.col(f) - F.lit(c) for f, c in zip(features, origin)]
    out = [F.sum(F.lit(1.0)).alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy")]
    for i, a in enumerate(x):
        out += [F.sum(F.lit(origin[i])).alias(f"c{i}"), F.sum(a).alias(f"s{i}"), F.sum(a * F.col(y)).alias(f"s{i}y")]
        out += [F.sum(a * b).alias(f"s{i}_{j}") for j, b in enumerate(x) if j >= i]
    return out


def complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.dropna(subset=list(columns))


def cells(rows: DataFrame, features: Sequence[str], y: str, gap: int, keys: Sequence[str] = ()) -> DataFrame:
    """Sums by time and eligibility. Any row of the data will do as the origin of its inputs."""
    used = complete(rows, [*features, y, "label_end_idx"])
    first = used.select(*features).first()
    origin = [float(first[f]) if first and np.isfinite(first[f]) else 0.0 for f in features]
    return used.groupBy(*keys, "t_idx", eligible(gap).alias("e")).agg(*_moments(features, y, origin))


def fold_sums(cells_: DataFrame, folds: DataFrame, role: str = "train") -> DataFrame:
    """Sums of each fold's training cells (or of its test cells)."""
    keys = [c for c in folds.columns if c not in ("train_start", "train_end", "test_start", "test_end")]
    sums = [c for c in cells_.columns if c not in ("t_idx", "e", "asset")]
    # What is eligible (e) before the test's start lies before it in time too.
    both = meet(cells_, folds, "train_start", "test_start").filter(F.col("e") < F.col("test_start")) if role == "train" else meet(cells_, folds, "test_start", "test_end")
    return both.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))


def _system(row: dict, p: int, intercept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Centred moments: S_xx, S_xy, means of x, mean of y; about 0 without an intercept."""
    n, sums = row["n"], np.array([row[f"s{i}"] for i in range(p)])
    origin = np.array([row[f"c{i}"] for i in range(p)]) / n
    xx = np.array([[row[f"s{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
    xy = np.array([row[f"s{i}y"] for i in range(p)])
    if not intercept:
        both = np.outer(origin, sums)
        return xx + both + both.T + n * np.outer(origin, origin), xy + origin * row["sy"], np.zeros(p), 0.0
    mean, my = sums / n, row["sy"] / n
    return xx - n * np.outer(mean, mean), xy - n * mean * my, mean + origin, my


def solve(sums: DataFrame, features: Sequence[str], alphas: Sequence[float], keys: Sequence[str], intercept: bool = True) -> DataFrame:
    """(keys, alpha, n_train, intercept, coefs): a row for each fold and penalty."""
    p, keys = len(features), list(keys)
    kinds = [f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys]

    def run(frames):
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                xx, xy, mean, my = _system(row, p, intercept)
                for alpha in alphas:
                    a = xx + alpha * np.eye(p)
                    beta = np.linalg.lstsq(a, xy, rcond=None)[0] if alpha == 0 else np.linalg.solve(a, xy)
                    out.append([*(row[k] for k in keys), float(alpha), int(row["n"]), float(my - beta @ mean), beta.tolist()])
            yield pd.DataFrame(out, columns=[*keys, "alpha", "n_train", "intercept", "coefs"])

    return sums.mapInPandas(run, ", ".join([*kinds, "alpha double, n_train long, intercept double, coefs array<double>"]))


def fit(rows: DataFrame, folds: DataFrame, features: Sequence[str], y: str = "y", alphas: Sequence[float] = (1.0,), gap: int = 20, intercept: bool = True) -> DataFrame:
    keys = [c for c in ("asset", "outer_fold_id", "inner_fold_id") if c in folds.columns]
    made = cells(rows, features, y, gap, ["asset"] if "asset" in folds.columns else [])
    return solve(fold_sums(made, folds), features, alphas, keys, intercept)


def long_coefs(fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """A row for each coefficient, the intercept among them."""
    keys = [c for c in fits.columns if c != "coefs" and c != "intercept"]
    named = F.arrays_zip(F.array(*map(F.lit, ["intercept", *features])).alias("feature"), F.concat(F.array("intercept"), "coefs").alias("coef"))
    return fits.select(*keys, F.inline(named).alias("feature", "coef"))


def predict(rows: DataFrame, folds: DataFrame, fits: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows of each fold's test span with ``pred``; NULL where an input is NULL."""
    keys = [c for c in ("asset", "outer_fold_id", "inner_fold_id") if c in folds.columns]
    models = folds.join(fits, keys)  # a few models for each fold
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coefs")[i] * F.col(f)
    return meet(rows, models, "test_start", "test_end", folds).withColumn("pred", pred).drop("coefs", "intercept", "train_start", "train_end", "test_start", "test_end")


def losses(test: DataFrame, fits: DataFrame, features: Sequence[str], keys: Sequence[str], names: Sequence[str] = ("alpha",)) -> DataFrame:
    """(keys, names, n_test, mse) of each fit on test sums, without touching rows again."""
    p = len(features)
    both = test.join(fits, list(keys))
    b, a = F.col("coefs"), F.col("intercept")
    for i in range(p):  # the sums are of inputs less their origin
        a = a + b[i] * F.col(f"c{i}") / F.col("n")
    sse = F.col("syy") - 2 * a * F.col("sy") + a * a * F.col("n")
    for i in range(p):
        sse = sse - 2 * b[i] * F.col(f"s{i}y") + 2 * a * b[i] * F.col(f"s{i}")
        for j in range(p):
            sse = sse + b[i] * b[j] * F.col(f"s{min(i, j)}_{max(i, j)}")
    return both.select(*keys, *names, F.col("n").cast("long").alias("n_test"), (sse / F.col("n")).alias("mse"))
