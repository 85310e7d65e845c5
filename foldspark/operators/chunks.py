"""Windows over few, very long series, in chunks of time.

A series of n bars is cut into n / ``rows`` chunks of equal duration.  A chunk also gets the bars before
and after it that its windows reach into (the halo), counted in bars and not in time, so chunks of
gaps reach back over several others.  Windows then run inside (asset, chunk): as many tasks as
chunks, and the same values as over whole series.  What is computed for halo bars is dropped.

It serves everything whose frames have a bounded number of bars of one asset; families
tell theirs by ``memory``.  Frames without a bound, or across assets, are not for chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bars of a chunk.
ROWS = 200_000


def _seconds(ts: str | Column) -> Column:
    return F.datediff(ts, F.lit("1970-01-01").cast("date")) * F.lit(86400).cast("long") + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _halo(placed: DataFrame, sizes: DataFrame, n: int, before: bool) -> DataFrame:
    """The ``n`` bars before (or after) each chunk, with the chunk they are for in ``_to``."""
    by = Window.partitionBy("asset").orderBy(F.col("_chunk") if before else F.desc("_chunk"))
    others = sizes.withColumn("_others", F.collect_list(F.struct("_chunk", "_m")).over(by.rowsBetween(1, n)))
    ahead = F.transform("_others", lambda x, i: F.struct(x["_chunk"].alias("_to"), F.aggregate(F.slice("_others", 1, i), F.lit(0).cast("long"), lambda a, y: a + y["_m"]).alias("_between")))
    reach = others.select("asset", "_chunk", F.explode(F.filter(ahead, lambda x: x["_between"] < n)).alias("_x")).select("asset", "_chunk", "_x.*")
    order = Window.partitionBy("asset", "_chunk").orderBy(F.desc("bar_ts") if before else F.col("bar_ts"))
    near = placed.withColumn("_r", F.row_number().over(order) - 1).filter(F.col("_r") < n)
    return near.join(reach, ["asset", "_chunk"]).filter(F.col("_between") + F.col("_r") < n).drop("_r", "_between", "_chunk")


def in_chunks(bars: DataFrame, make: Callable[[DataFrame], DataFrame], back: int, ahead: int = 0, rows: int = ROWS) -> DataFrame:
    """``make(bars)``, which has asset and bar_ts, for a ``make`` that sees ``back`` bars before and ``ahead`` bars after a bar."""
    at = _seconds("bar_ts")
    spans = bars.groupBy("asset").agg(F.ceil(F.count(F.lit(1)) / rows).alias("_k"), F.min(at).alias("_first"), F.max(at).alias("_last"))
    chunk = F.floor((at - F.col("_first")) * F.col("_k") / (F.col("_last") - F.col("_first") + 1)).cast("int")
    placed = bars.join(spans, "asset").withColumn("_chunk", chunk).drop("_k", "_first", "_last")
    sizes = placed.groupBy("asset", "_chunk").agg(F.count(F.lit(1)).alias("_m"), F.min("bar_ts").alias("_low"), F.max("bar_ts").alias("_high"))
    every = placed.withColumnRenamed("_chunk", "_to")
    for n, before in ((back, True), (ahead, False)):
        if n:
            every = every.unionByName(_halo(placed, sizes, n, before))
    own = sizes.select("asset", F.col("_chunk").alias("_to"), "_low", "_high")
    # The chunk takes the place of the asset while windows run.
    keyed = every.join(own, ["asset", "_to"]).withColumn("asset", F.struct("asset", "_to", "_low", "_high")).drop("_to", "_low", "_high")
    made = make(keyed)
    inside = (F.col("bar_ts") >= F.col("asset._low")) & (F.col("bar_ts") <= F.col("asset._high"))
    return made.filter(inside).withColumn("asset", F.col("asset.asset"))
