"""Tables for looking at runs; each is ready to plot."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.functions.features import with_returns
from foldspark.operators.diagnostics import regression_metrics
from foldspark.operators.lineage import cut


def performance(scored: DataFrame) -> DataFrame:
    return regression_metrics(scored, ["outer_fold_id"])


def residuals_by_time(scored: DataFrame, unit: str = "day") -> DataFrame:
    e = F.col("y") - F.col("pred")
    period = F.date_trunc(unit, "bar_ts").cast("timestamp_ntz").alias("period")
    return scored.filter("y is not null and pred is not null").groupBy("asset", period).agg(F.avg(e).alias("bias"), F.stddev_pop(e).alias("std"), F.count(F.lit(1)).alias("n"))


def subgroups(scored: DataFrame, by: tuple[str, str] = ("outer_fold_id", "asset")) -> DataFrame:
    """Errors of each pair of groups, each first group, and in total."""
    e = F.col("y") - F.col("pred")
    return scored.filter("y is not null and pred is not null").rollup(*by).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def compare(runs: dict[str, DataFrame], base: str) -> DataFrame:
    """(fold, candidate, rmse, delta): each run's error against the base run's."""
    table = None
    for name, scored in runs.items():
        own = regression_metrics(scored, ["outer_fold_id"]).select("outer_fold_id", F.lit(name).alias("candidate"), "rmse")
        table = own if table is None else table.unionByName(own)
    other = table.filter(F.col("candidate") == base).select("outer_fold_id", F.col("rmse").alias("_base"))
    return table.join(other, "outer_fold_id", "left").withColumn("delta", F.col("rmse") - F.col("_base")).drop("_base")


#: Assets and times of a block, and parts whose sums are added up together.
ASSETS, TIMES, PARTS = 64, 512, 64
_SUMS = 6


def _panels(rets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, block, times, panel): the returns of a block of assets at a part of the times, NaN where there is none;
    and (asset, block, col)."""
    names = rets.select("asset").distinct()
    number = Window.orderBy("asset")  # a row an asset
    numbered = names.withColumn("_i", F.row_number().over(number) - 1).select("asset", F.floor(F.col("_i") / ASSETS).cast("int").alias("block"), (F.col("_i") % ASSETS).cast("int").alias("col"))
    times = rets.select("bar_ts").distinct()
    days = times.groupBy(F.date_trunc("day", "bar_ts").alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    part = days.withColumn("part", F.floor((F.sum("_n").over(Window.orderBy("_day")) - 1) / TIMES).cast("int")).drop("_n")  # a row a day
    placed = rets.join(numbered, "asset").withColumn("_day", F.date_trunc("day", "bar_ts")).join(part, "_day")

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        at, times = pd.factorize(frame.bar_ts, sort=True)
        panel = np.full((len(times), ASSETS), np.nan)
        panel[at, frame.col] = frame.ret1
        when = times.to_numpy().astype("datetime64[us]").astype(np.int64)
        return pd.DataFrame([[frame.part.iloc[0], frame.block.iloc[0], when.tobytes(), panel.tobytes()]], columns=["part", "block", "times", "panel"])

    packed = placed.select("part", "block", "bar_ts", "col", "ret1").groupBy("part", "block").applyInPandas(pack, "part int, block int, times binary, panel binary")
    return packed, numbered


def _read(times: bytes, panel: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(times, np.int64), np.frombuffer(panel).reshape(-1, ASSETS)


def asset_correlations(bars: DataFrame) -> DataFrame:
    """(asset, other, n, corr) of one-bar returns at the same times, for each pair of assets once.

    Returns are laid out as blocks of ``ASSETS`` assets by parts of about ``TIMES`` times (whole days).  Two blocks of
    one part give all sums of their pairs by matrix products, with masks for missing returns; sums of
    parts are added up.  A return moves once for each block of assets and not for each asset.
    """
    packed, numbered = _panels(with_returns(bars).filter("ret1 is not null").select("bar_ts", "asset", "ret1"))
    packed = cut(packed)
    other = packed.select("part", F.col("block").alias("block2"), F.col("times").alias("times2"), F.col("panel").alias("panel2"))
    pairs = packed.join(other, "part").filter("block <= block2")

    def sums(frames):
        for frame in frames:
            for row in frame.itertuples(index=False):
                (t, x), (u, y) = _read(row.times, row.panel), _read(row.times2, row.panel2)
                _, i, j = np.intersect1d(t, u, assume_unique=True, return_indices=True)
                x, y = x[i], y[j]
                a, b = (~np.isnan(v) * 1.0 for v in (x, y))
                x, y = np.nan_to_num(x), np.nan_to_num(y)
                made = np.stack((a.T @ b, x.T @ b, a.T @ y, (x * x).T @ b, a.T @ (y * y), x.T @ y))
                yield pd.DataFrame([[row.block, row.block2, row.part // PARTS, made.tobytes()]], columns=["block", "block2", "some", "sums"])

    def added(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[key[0], key[1], sum(np.frombuffer(s) for s in frame.sums).tobytes()]], columns=["block", "block2", "sums"])

    def total(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        held = sum(np.frombuffer(s) for s in frame.sums).reshape(_SUMS, ASSETS, ASSETS)
        n, sx, sy, sxx, syy, sxy = held
        i, j = np.nonzero((n > 0) & ((key[0] < key[1]) | (np.arange(ASSETS)[:, None] < np.arange(ASSETS))))
        n, sx, sy, sxx, syy, sxy = (v[i, j] for v in held)
        vx, vy = sxx / n - (sx / n) ** 2, syy / n - (sy / n) ** 2
        fine = (n >= 3) & (vx > 1e-300) & (vy > 1e-300)
        corr = np.where(fine, (sxy / n - sx * sy / n**2) / np.sqrt(np.where(fine, vx * vy, 1.0)), np.nan)
        return pd.DataFrame({"block": key[0], "col": i, "block2": key[1], "col2": j, "n": n.astype(np.int64), "corr": corr})

    parts = pairs.mapInPandas(sums, "block int, block2 int, some int, sums binary")
    parts = parts.groupBy("block", "block2", "some").applyInPandas(added, "block int, block2 int, sums binary")
    table = parts.groupBy("block", "block2").applyInPandas(total, "block int, col int, block2 int, col2 int, n long, corr double")
    named = table.join(numbered, ["block", "col"]).join(numbered.select(F.col("asset").alias("other"), F.col("block").alias("block2"), F.col("col").alias("col2")), ["block2", "col2"])
    return named.select("asset", "other", "n", F.when(~F.isnan("corr"), F.col("corr")).alias("corr"))
