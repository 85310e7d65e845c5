"""Bars from tables of trades, and bars normalised to one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS = T.StructType(
    [T.StructField("asset", T.StringType()), T.StructField("bar_ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
    + [T.StructField("n_trades", T.LongType())]
)


def trade_bars(trades: DataFrame, asset: str | Column, ts: str, value: str, tie: str, unit: str) -> DataFrame:
    """Open, high, low, close and volume of each asset and time unit; ``tie`` orders trades of one instant."""
    asset = F.col(asset) if isinstance(asset, str) else asset
    order = F.struct(ts, tie)
    bar = F.date_trunc(unit, F.col(ts)).cast("timestamp_ntz")
    return trades.groupBy(asset.alias("asset"), bar.alias("bar_ts")).agg(
        F.min_by(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        F.sum(value).alias("volume"),
        F.count(F.lit(1)).alias("n_trades"),
    )


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each event type."""
    return trade_bars(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", "ts", "value", "event_id", "hour")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each market segment."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return trade_bars(joined, "c_mktsegment", "o_orderdate", "o_totalprice", "o_orderkey", "day")


def part_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each part brand over shipped lines: the largest panel."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    price = joined.withColumn("price", F.try_divide("l_extendedprice", "l_quantity")).withColumn("line", F.struct("l_orderkey", "l_linenumber"))
    return trade_bars(price, "p_brand", "l_shipdate", "price", "line", "day")


def normalise(raw: DataFrame, names: dict[str, str]) -> DataFrame:
    """Vendor rows in the schema of bars: ``names`` maps our columns to theirs; of a
    bar given twice the row with the largest volume stays."""
    rows = raw.select(*(F.col(names.get(f.name, f.name)).cast(f.dataType).alias(f.name) if names.get(f.name, f.name) in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in BARS))
    best = Window.partitionBy("asset", "bar_ts").orderBy(F.desc_nulls_last("volume"), F.desc_nulls_last("close"), F.desc_nulls_last("open"))
    return rows.withColumn("_r", F.row_number().over(best)).filter("_r = 1").drop("_r")


def in_universe(bars: DataFrame, universe: DataFrame, name: str) -> DataFrame:
    """Bars of the assets that ``universe`` (universe_name, asset) lists under a name."""
    return bars.join(universe.filter(F.col("universe_name") == name).select("asset"), "asset", "left_semi")


def with_time_index(bars: DataFrame) -> DataFrame:
    """Adds ``t_idx``, the number of the bar's time among all times. Only the distinct times meet in one task."""
    times = bars.select("bar_ts").distinct().withColumn("t_idx", (F.row_number().over(Window.orderBy("bar_ts")) - 1).cast("int"))
    return bars.join(times, "bar_ts")
