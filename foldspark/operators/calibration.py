"""Calibration of all folds at once: predictions on a curve fitted by fold.

Isotonic curves pool adjacent violators.  Pooling is associative: equal predictions are
one point, each bin of neighbouring points (:class:`foldspark.operators.order.Placed`) is
pooled in a task of its own, then what is left of the bins, larger and larger groups of them.
So a task holds a bin, or blocks that no pooling within their parts could join.
Folds without a row to fit on have no curve; their rows keep a NULL in ``proba``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.operators import logistic, order
from foldspark.operators.lineage import cut


def pooled(frame: pd.DataFrame) -> pd.DataFrame:
    """(lo, hi, n, s) in order of lo, with neighbours joined until the means s / n rise."""
    out: list[list[float]] = []
    for lo, hi, n, s in frame.sort_values("lo")[["lo", "hi", "n", "s"]].itertuples(index=False):
        out.append([lo, hi, n, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            last = out.pop()
            out[-1] = [out[-1][0], last[1], out[-1][2] + last[2], out[-1][3] + last[3]]
    return pd.DataFrame(out, columns=["lo", "hi", "n", "s"])


def _pooled_by(blocks: DataFrame, by: list[str]) -> DataFrame:
    def pool(frame: pd.DataFrame) -> pd.DataFrame:
        made = pooled(frame)
        for i, c in enumerate(by):
            made.insert(i, c, [frame[c].iloc[0]] * len(made))
        return made

    kinds = [f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in by]
    return blocks.groupBy(*by).applyInPandas(pool, ", ".join([*kinds, "lo double, hi double, n double, s double"]))


def isotonic_curves(fit_rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, from, until, hi, value, next_lo, next_value): the pieces of each fold's increasing curve. It is constant
    up to ``hi``, from there a line to the next piece; beyond both ends it stays as it is there."""
    keys = list(keys)
    used = fit_rows.filter("pred is not null and y is not null").select(*keys, "pred", F.col("y").cast("double").alias("y"))
    points = cut(used.groupBy(*keys, "pred").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("y").alias("s")))
    x = F.col("pred").cast("double")
    blocks = order.Placed(points, keys, "pred").rows.select(*keys, F.col("_bin")[0].alias("_part"), F.array_join("_bin", ".").alias("_leaf"), x.alias("lo"), x.alias("hi"), "n", "s")
    blocks = _pooled_by(_pooled_by(blocks, [*keys, "_part", "_leaf"]), [*keys, "_part"])
    kinds = [f"`{k}` {fit_rows.schema[k].dataType.simpleString()}" for k in keys]

    def curve(frame):
        made = pooled(frame)
        value = made.s / made.n
        out = pd.DataFrame({"from": made.lo, "until": made.lo.shift(-1), "hi": made.hi, "value": value, "next_lo": made.lo.shift(-1), "next_value": value.shift(-1)})
        out.loc[0, "from"], out.loc[len(out) - 1, "until"] = -np.inf, np.inf
        for i, k in enumerate(keys):
            out.insert(i, k, [frame[k].iloc[0]] * len(out))
        return out

    return blocks.groupBy(*keys).applyInPandas(curve, ", ".join([*kinds, "`from` double, until double, hi double, value double, next_lo double, next_value double"]))


def isotonic(fit_rows: DataFrame, rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``proba``: ``pred`` on the increasing curve of its fold (``keys``), fitted on ``fit_rows`` (pred, y)."""
    curves = cut(isotonic_curves(fit_rows, keys))
    near = order._same("r", "c", keys) & (F.col("r.pred") >= F.col("c.from")) & (F.col("r.pred") < F.col("c.until"))
    share = F.try_divide(F.col("r.pred") - F.col("c.hi"), F.col("c.next_lo") - F.col("c.hi"))
    line = F.col("c.value") + (F.col("c.next_value") - F.col("c.value")) * share
    proba = F.when((F.col("r.pred") <= F.col("c.hi")) | F.col("c.next_lo").isNull(), F.col("c.value")).otherwise(line)
    return rows.filter("pred is not null").alias("r").join(curves.alias("c"), near, "left").select("r.*", proba.alias("proba"))


def platt(fit_rows: DataFrame, rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``rows`` with ``proba`` from a logistic curve of ``pred``, by fold."""
    keys = list(keys)
    only = [] if keys else ["_all"]
    own = lambda df: df if keys else df.withColumn("_all", F.lit(0))
    curves = logistic.fit(own(fit_rows.filter("pred is not null and y is not null")), ["pred"], keys or only).select(*(keys or only), "intercept", "coefs")
    both = own(rows.filter("pred is not null")).join(curves, keys or only, "left")
    return both.withColumn("proba", logistic.probability(["pred"])).select(*rows.columns, "proba")


CURVES = {"isotonic": isotonic, "platt": platt}
