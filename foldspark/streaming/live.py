"""Bars from a stream of trades, features of fresh bars, and scoring with persisted coefficients."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foldspark.functions.features import FeatureFamily
from foldspark.sources import files


def stream_bars(trades: DataFrame, unit: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Bars of a stream (asset, ts, value, event_id); trades later than ``late`` are dropped, as a stream must."""
    order = F.struct("ts", "event_id")
    return (
        trades.withWatermark("ts", late)
        .groupBy(F.window("ts", unit).alias("w"), "asset")
        .agg(
            F.min_by("value", order).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", order).alias("close"),
            F.sum("value").alias("volume"),
            F.count(F.lit(1)).alias("n_trades"),
        )
        .select("asset", F.col("w.start").cast("timestamp_ntz").alias("bar_ts"), "open", "high", "low", "close", "volume", "n_trades")
    )


def run_features(bars: DataFrame, family: FeatureFamily, params: Mapping[str, Any], out: str, state: str, checkpoint: str) -> StreamingQuery:
    """The family's features of each finished bar, as they are in a batch over all bars.

    Between batches each asset's last ``memory`` bars are kept: a batch reads those that the one before it left,
    computes over both, keeps the rows of its own bars, and leaves the last bars again.  Two folders take turns, so a
    batch that runs once more after a failure finds what it read before and replaces what it wrote.
    Bars of an asset must come in order, as those of :func:`stream_bars` do.
    """
    memory = family.memory(params)
    if memory is None:
        raise ValueError(f"{family.name} depends on bars without a bound or on other assets")

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["asset", "bar_ts"]).persist()
        before = files.join(state, str((n + 1) % 2))
        kept = spark.read.parquet(before).filter(F.col("_batch") < n).drop("_batch") if files.complete(spark, before) else fresh.limit(0)
        both = kept.select(*fresh.columns).unionByName(fresh)
        family.apply(both, params).join(fresh.select("asset", "bar_ts"), ["asset", "bar_ts"], "left_semi").write.mode("overwrite").parquet(files.join(out, f"batch={n}"))
        last = Window.partitionBy("asset").orderBy(F.desc("bar_ts"))
        trail = both.withColumn("_r", F.row_number().over(last)).filter(F.col("_r") <= memory).drop("_r").withColumn("_batch", F.lit(n))
        trail.write.mode("overwrite").parquet(files.join(state, str(n % 2)))
        fresh.unpersist()

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").start()


def score(rows: DataFrame, coefs: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows with ``pred`` from one model's (intercept, coefs)."""
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coefs")[i] * F.col(f)
    return rows.crossJoin(F.broadcast(coefs.select("intercept", "coefs").limit(1))).withColumn("pred", pred).drop("intercept", "coefs")


def run_scoring(bars: DataFrame, features: Callable[[DataFrame], DataFrame], coefs: DataFrame, names: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Scores each batch of finished bars; ``features`` may read kept bars, as lags cannot run on a stream."""

    def write(batch: DataFrame, _: int) -> None:
        score(features(batch), coefs, names).write.mode("append").parquet(out)

    return bars.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append").start()
