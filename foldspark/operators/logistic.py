"""Logistic regression of all folds at once, by iteratively reweighted least squares.

A round is one pass over the training rows of the folds that are not done: each row's
weight and residual under its fold's coefficients are added up by fold, and each fold's
small system is solved where its sums are.  Sums are partly aggregated before they
move, so what a round shuffles is a row a fold and task.  The folds' coefficients are a
table that is written after each round.

Inputs are standardised by the fold's training rows; the penalty is on standardised
coefficients.  A step that makes the objective worse is halved.  Folds with one class
only have no slopes; folds whose classes can be told apart without error stop when
their loss is next to nothing, or after ``ROUNDS`` rounds, and are not ``converged``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators.lineage import cut

ROUNDS, TOLERANCE = 30, 1e-9


def _step(row: dict, p: int, alpha: float, tolerance: float) -> dict:
    """The next state of one fold from its sums at ``beta``."""
    beta, n = np.asarray(row["beta"], float), row["n"]
    penalty = np.r_[0.0, np.full(p, alpha * n)]
    loss = row["loss"] + 0.5 * float(penalty @ (beta * beta))
    out = {"beta": beta, "last": row["last"], "best": row["best"], "rounds": int(row["rounds"]) + 1, "done": False, "converged": False}
    if row["last"] is not None and loss > row["best"] + 1e-10 * (1 + abs(row["best"])):
        out["beta"] = (beta + np.asarray(row["last"], float)) / 2
        out["done"] = bool(np.abs(out["beta"] - beta).max() < 1e-14)
        return out
    h = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p + 1)] for i in range(p + 1)]) + np.diag(penalty)
    g = np.array([row[f"g{i}"] for i in range(p + 1)]) - penalty * beta
    # Not at its best by a gap that no digit shows: the gradient tells, and so does a loss of nothing.
    if loss < 1e-8 * n:
        return out | {"done": True}
    delta = np.linalg.lstsq(h, g, rcond=1e-14)[0]
    done = bool(np.abs(delta).max() < tolerance)
    return out | {"beta": beta + delta, "last": beta, "best": loss, "done": done, "converged": done}


def fit(train: DataFrame, features: Sequence[str], keys: Sequence[str], alpha: float = 0.0, rounds: int = ROUNDS, tolerance: float = TOLERANCE, y: str = "y") -> DataFrame:
    """(keys, n_train, rounds, converged, intercept, coefs) of the training rows of each fold; ``y`` is 0 or 1.
    Rows with a NULL in an input or the label train nothing."""
    p, keys = len(features), list(keys)
    used = train.dropna(subset=[*features, y]).select(*keys, *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)), F.col(y).cast("double").alias("_y"))
    made = [g.alias(f"{n}{i}") for i in range(p) for n, g in (("m", F.avg(f"_x{i}")), ("s", F.stddev_samp(f"_x{i}")))]
    stats = used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n1"), *made)
    arrays = [F.array(*(F.coalesce(f"{c}{i}", F.lit(0.0)) for i in range(p))).alias(c) for c in "ms"]
    odds = F.ln((F.col("n1") + 0.5) / (F.col("n") - F.col("n1") + 0.5))
    one = (F.col("n1") <= 0) | (F.col("n1") >= F.col("n"))
    start = F.concat(F.array(F.when(one, odds).otherwise(0.0)), F.array_repeat(F.lit(0.0), p))
    state = cut(stats.select(
        *keys, "n", *arrays, start.alias("beta"), F.lit(None).cast("array<double>").alias("last"), F.lit(0.0).alias("best"), F.lit(0).alias("rounds"), one.alias("done"), F.lit(False).alias("converged"),
    ))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)

    def run(frames):
        for frame in frames:
            rows = [{c: r[c] for c in (*keys, "n", "m", "s")} | _step(r, p, alpha, tolerance) for r in frame.replace({np.nan: None}).to_dict("records")]
            yield pd.DataFrame([[None if r[c] is None else r[c].tolist() if isinstance(r[c], np.ndarray) else r[c] for c in names] for r in rows], columns=names)

    names = state.columns
    finished = []
    for _ in range(rounds):
        open_ = state.filter("not done")
        finished.append(state.filter("done"))
        if open_.isEmpty():
            break
        both = used.join(open_, keys)
        z = [F.lit(1.0), *(F.coalesce(F.try_divide(F.col(f"_x{i}") - F.col("m")[i], F.col("s")[i]), F.lit(0.0)) for i in range(p))]
        both = both.select(*keys, "_y", *(c.alias(f"z{i}") for i, c in enumerate(z)), sum((F.col("beta")[i] * c for i, c in enumerate(z)), F.lit(0.0)).alias("eta"))
        both = both.withColumn("p", 1 / (1 + F.exp(-F.col("eta"))))
        w = F.col("p") * (1 - F.col("p"))
        sums = [F.sum(F.log1p(F.exp(-F.abs("eta"))) + F.greatest("eta", F.lit(0.0)) - F.col("_y") * F.col("eta")).alias("loss")]
        sums += [F.sum((F.col("_y") - F.col("p")) * F.col(f"z{i}")).alias(f"g{i}") for i in range(p + 1)]
        sums += [F.sum(w * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
        state = cut(both.groupBy(*keys).agg(*sums).join(open_, keys).mapInPandas(run, kinds))
    else:
        finished.append(state)
    out = finished[0]
    for more in finished[1:]:
        out = out.unionByName(more)
    slopes = F.transform(F.arrays_zip(F.slice("beta", 2, max(p, 1)).alias("b"), F.col("s").alias("s")), lambda x: F.coalesce(F.try_divide(x["b"], x["s"]), F.lit(0.0)))
    out = out.withColumn("coefs", slopes)
    moved = F.aggregate(F.arrays_zip(F.col("coefs").alias("c"), F.col("m").alias("m")), F.lit(0.0), lambda a, x: a + x["c"] * x["m"])
    return out.select(*keys, F.col("n").alias("n_train"), "rounds", "converged", (F.col("beta")[0] - moved).alias("intercept"), "coefs")


def probability(features: Sequence[str]) -> Column:
    """Of rows that carry ``intercept`` and ``coefs``."""
    eta = F.col("intercept")
    for i, f in enumerate(features):
        eta = eta + F.col("coefs")[i] * F.col(f)
    return 1 / (1 + F.exp(-eta))
