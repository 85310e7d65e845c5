"""Exact quantiles and average ranks by group without sorting a group in one task.

The values of a group (a fold, a feature of a fold) are dealt into bins that keep their
order: first of equal width on a logarithmic scale, then bins that hold too much are cut
again into bins of equal width between their smallest and largest value.  That ends
when each bin has at most ``LIMIT`` rows or only one value.  How many rows lie below a
bin follows from the counts; only inside bins is anything sorted.  Groups of up to
``LIMIT`` rows are one bin.  NULLs take no part; NaN counts as NULL.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.lineage import cut

#: Rows of different values that are sorted together, and bins that a bin is cut into.
LIMIT, BINS = 50_000, 1024
#: Cuts in a row; each divides the width of a bin by ``BINS``.
LEVELS = 12


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys), F.lit(True))


def _at(x: Column, low: Column, high: Column) -> Column:
    """The bin of ``x`` between ``low`` and ``high``; never falls as ``x`` grows."""
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    return F.when(low < high, F.least(F.floor(share * BINS), F.lit(BINS - 1)).cast("int")).otherwise(F.lit(0))


def _log(x: Column, unit: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x) / unit)


class Placed:
    """Rows with the bin of their value: ``rows`` has ``_bin`` (an array of places), ``bins`` a row
    for each bin: keys, _bin, _n, _low, _high, _before (rows of the group in lower bins), _total (rows of the group)."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], value: str, limit: int | None = None):
        limit = LIMIT if limit is None else limit
        self.keys, self.value = list(keys), value
        x = F.col(value)
        rows = rows.filter(x.isNotNull() & ~F.isnan(x.cast("double"))).withColumn("_x", x.cast("double"))
        stats = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.avg(F.abs("_x")).alias("_mean"))
        unit = F.when((F.col("_mean") > 0) & (F.col("_mean") < 1e300), F.col("_mean")).otherwise(1.0)
        first = _at(_log(F.col("_x"), unit), _log(F.col("_min"), unit), _log(F.col("_max"), unit))
        both = rows.alias("r").join(stats.alias("s"), _same("r", "s", keys)).select("r.*", F.array(F.when(F.col("_total") > limit, first).otherwise(0)).alias("_bin"))
        made = self._counted(both)
        for _ in range(LEVELS):
            heavy = made.filter((F.col("_n") > limit) & (F.col("_low") < F.col("_high"))).select(*keys, "_bin", "_low", "_high")
            if heavy.isEmpty():
                break
            joined = both.alias("r").join(heavy.alias("h"), _same("r", "h", [*keys, "_bin"]), "left")
            finer = F.when(F.col("_low").isNull(), F.col("r._bin")).otherwise(F.concat(F.col("r._bin"), F.array(_at(F.col("_x"), F.col("_low"), F.col("_high")))))
            both = joined.select(*(F.col(f"r.{c}") for c in both.columns if c != "_bin"), finer.alias("_bin"))
            made = self._counted(both)
        by = Window.partitionBy(*keys).orderBy("_bin")
        before = F.coalesce(F.sum("_n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        self.bins = made.withColumns({"_before": before, "_total": F.sum("_n").over(Window.partitionBy(*keys))})
        self.rows = both

    def _counted(self, rows: DataFrame) -> DataFrame:
        return cut(rows.groupBy(*self.keys, "_bin").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")))

    def ranked(self, out: str) -> DataFrame:
        """The rows with their average rank in the group, from 1. Rows of a bin of one value need no sort and are spread."""
        both = self.rows.alias("r").join(self.bins.alias("b"), _same("r", "b", [*self.keys, "_bin"])).select("r.*", "_before", "_n", (F.col("_low") == F.col("_high")).alias("_one"))
        spread = F.when(F.col("_one"), F.pmod(F.monotonically_increasing_id(), F.lit(BINS)))
        both = both.withColumn("_spread", spread)
        within = Window.partitionBy(*self.keys, "_bin", "_spread")
        rank = F.rank().over(within.orderBy("_x")) + (F.count(F.lit(1)).over(Window.partitionBy(*self.keys, "_bin", "_spread", "_x")) - 1) / 2
        value = F.col("_before") + F.when(F.col("_one"), (F.col("_n") + 1) / 2).otherwise(rank)
        return both.withColumn(out, value.cast("double")).drop("_x", "_bin", "_before", "_n", "_one", "_spread")

    def quantiles(self, at: Sequence[float], out: str = "quantiles") -> DataFrame:
        """(keys, out): the group's quantiles at the shares ``at``, interpolated between neighbours. Only bins with one of them are sorted."""
        shares = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(at)))
        asked = self.bins.select(*self.keys, "_bin", "_n", "_low", "_high", "_before", "_total", F.explode(shares).alias("_a"))
        place = (F.col("_total") - 1) * F.col("_a.p")
        asked = asked.withColumn("_place", place).withColumn("_r", F.explode(F.array_distinct(F.array(F.floor("_place"), F.ceil("_place")))))
        inside = F.col("_r") - F.col("_before")
        asked = asked.withColumn("_inside", inside).filter((inside >= 0) & (inside < F.col("_n")))
        asked = asked.withColumn("_w", F.when(F.floor("_place") == F.ceil("_place"), 1.0).when(F.col("_r") == F.floor("_place"), F.ceil("_place") - F.col("_place")).otherwise(F.col("_place") - F.floor("_place")))
        one = asked.filter("_low = _high").select(*self.keys, F.col("_a.i").alias("_i"), "_w", F.col("_low").alias("_v"))
        several = asked.filter("_low < _high").select(*self.keys, "_bin", F.col("_a.i").alias("_i"), "_w", "_inside")
        wanted = several.select(*self.keys, "_bin").distinct()
        some = self.rows.alias("r").join(wanted.alias("w"), _same("r", "w", [*self.keys, "_bin"]), "left_semi").select(*self.keys, "_bin", "_x")
        order = some.withColumn("_inside", (F.row_number().over(Window.partitionBy(*self.keys, "_bin").orderBy("_x")) - 1).cast("long"))
        hit = order.alias("r").join(several.alias("w"), _same("r", "w", [*self.keys, "_bin", "_inside"])).select(*(F.col(f"r.{k}").alias(k) for k in self.keys), "_i", "_w", F.col("_x").alias("_v"))
        points = one.unionByName(hit).groupBy(*self.keys, "_i").agg(F.sum(F.col("_w") * F.col("_v")).alias("_q"))
        return points.groupBy(*self.keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_q"))), lambda s: s["_q"]).alias(out))


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], out: str = "quantiles", limit: int | None = None) -> DataFrame:
    """(keys, out): exact quantiles of each group that has any value."""
    return Placed(cut(rows.select(*keys, value)), keys, value, limit).quantiles(at, out)


def average_ranks(rows: DataFrame, keys: Sequence[str], value: str, out: str, limit: int | None = None) -> DataFrame:
    """``rows`` with a value, and its average rank in the group (from 1) in ``out``."""
    return Placed(cut(rows), keys, value, limit).ranked(out)
