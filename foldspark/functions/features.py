"""Feature families: lists of causal column expressions, no joins.

A family builds columns over the frames that end at the current bar, so nothing of
it can see the future.  Families over one table of bars compose in one ``select``;
columns that share a window share its sort.
"""

from __future__ import annotations

import hashlib
import json
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

def by_asset() -> WindowSpec:
    return Window.partitionBy("asset").orderBy("bar_ts")


def by_time() -> WindowSpec:
    return Window.partitionBy("bar_ts")


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(a, b)


def past_return(n: int) -> Column:
    close = F.col("close")
    return ratio(close, F.lag(close, n).over(by_asset())) - 1


def trailing(value: Column, n: int, what: Callable[[Column], Column]) -> Column:
    """An aggregate of the last ``n`` bars, NULL until all of them have a value."""
    frame = by_asset().rowsBetween(-(n - 1), 0)
    return F.when(F.count(value).over(frame) == n, what(value).over(frame))


def last_known(value: Column) -> Column:
    """The last value that is not NULL, of this bar or one before."""
    return F.last(value, ignorenulls=True).over(by_asset().rowsBetween(Window.unboundedPreceding, 0))


@dataclass(frozen=True)
class Feature:
    name: str
    value: Column


class FeatureFamily(ABC):
    """A named family; ``version`` changes when its formulas do."""

    name: str = ""
    version: str = "1"
    defaults: Mapping[str, Any] = {}

    @abstractmethod
    def build(self, params: Mapping[str, Any]) -> list[Feature]:
        """Columns over bars that also have ``ret1``, the last bar's return."""

    def memory(self, params: Mapping[str, Any]) -> int | None:
        """How many earlier bars of its asset a row depends on; None if there is no bound, or on other assets."""
        return None

    def apply(self, bars: DataFrame, params: Mapping[str, Any]) -> DataFrame:
        made = self.build({**self.defaults, **params})
        return with_returns(bars).select("asset", "bar_ts", *(f.value.alias(f.name) for f in made))


def with_returns(bars: DataFrame) -> DataFrame:
    return bars.withColumn("ret1", past_return(1))


class Baseline(FeatureFamily):
    """Past returns, trailing volatility, momentum, range and volume of an asset."""

    name = "baseline"
    defaults = {"returns": (1, 5, 20), "window": 20}

    def memory(self, params: Mapping[str, Any]) -> int:
        p = {**self.defaults, **params}
        return max(*p["returns"], p["window"])

    def build(self, params: Mapping[str, Any]) -> list[Feature]:
        n, close, volume = params["window"], F.col("close"), F.col("volume")
        return [
            *(Feature(f"ret{k}", past_return(k)) for k in params["returns"]),
            Feature(f"mean{n}", trailing(close, n, F.avg)),
            Feature(f"vol{n}", trailing(F.col("ret1"), n, F.stddev_samp)),
            Feature(f"mom{n}", ratio(close, trailing(close, n, F.avg)) - 1),
            Feature("range1", ratio(F.col("high") - F.col("low"), close)),
            Feature(f"volz{n}", ratio(volume - trailing(volume, n, F.avg), trailing(volume, n, F.stddev_samp))),
        ]


class CrossAsset(FeatureFamily):
    """An asset's return against all assets at the same time, and its trailing beta to their mean."""

    name = "cross_asset"
    defaults = {"window": 20}

    def build(self, params: Mapping[str, Any]) -> list[Feature]:
        n, ret = params["window"], F.col("ret1")
        market = F.col("market")
        both = F.when(ret.isNotNull() & market.isNotNull(), ret * market)
        cov = trailing(both, n, F.avg) - trailing(ret, n, F.avg) * trailing(market, n, F.avg)
        var = trailing(market * market, n, F.avg) - trailing(market, n, F.avg) * trailing(market, n, F.avg)
        return [
            Feature("xs_demeaned", ret - market),
            Feature("xs_rank", F.when(ret.isNotNull(), F.percent_rank().over(by_time().orderBy(ret.asc_nulls_first())))),
            Feature("xs_count", F.count(ret).over(by_time())),
            Feature(f"beta{n}", F.when(F.abs(var) > 1e-18, ratio(cov, var))),
        ]

    def apply(self, bars: DataFrame, params: Mapping[str, Any]) -> DataFrame:
        made = self.build({**self.defaults, **params})
        rows = with_returns(bars).withColumn("market", F.avg("ret1").over(by_time()))
        return rows.select("asset", "bar_ts", *(f.value.alias(f.name) for f in made))


class Regime(FeatureFamily):
    """Whether volatility is high against its own past, and the sign of the trend."""

    name = "regime"
    defaults = {"window": 20, "past": 60, "share": 0.75}

    def memory(self, params: Mapping[str, Any]) -> int:
        p = {**self.defaults, **params}
        return p["past"] + p["window"]

    def apply(self, bars: DataFrame, params: Mapping[str, Any]) -> DataFrame:
        p = {**self.defaults, **params}
        vol = trailing(F.col("ret1"), p["window"], F.stddev_samp)
        rows = with_returns(bars).withColumn("vol", vol).withColumn("mean", trailing(F.col("close"), p["window"], F.avg))
        return rows.select("asset", "bar_ts", *(f.value.alias(f.name) for f in self.build(p)))

    def build(self, params: Mapping[str, Any]) -> list[Feature]:
        n = params["past"]
        frame = by_asset().rowsBetween(-n, -1)
        edge = F.when(F.count("vol").over(frame) == n, F.percentile("vol", F.lit(params["share"])).over(frame))
        return [
            Feature("vol_edge", edge),
            Feature("high_vol", F.when(edge.isNotNull() & F.col("vol").isNotNull(), (F.col("vol") > edge).cast("int"))),
            Feature("trend", F.when(F.col("mean").isNotNull(), F.signum(F.col("close") - F.col("mean")).cast("int"))),
        ]


class FieldAdapter(FeatureFamily):
    """Features from an outside package, given as a function of bars and parameters.

    Nothing of the package is known here.  Its rows are (asset, bar_ts, features...);
    it must be causal, which :func:`foldspark.operators.leakage.causal` can test.
    """

    name = "field_adapter"

    def __init__(self, compute: Callable[[DataFrame, Mapping[str, Any]], DataFrame] | None = None, version: str = "1"):
        self.compute, self.version = compute, version

    def build(self, params: Mapping[str, Any]) -> list[Feature]:
        raise TypeError("an adapter computes a table, not columns")

    def apply(self, bars: DataFrame, params: Mapping[str, Any]) -> DataFrame:
        if self.compute is None:
            raise LookupError("no field package is plugged in: register FieldAdapter(compute)")
        made = self.compute(bars, params)
        if made.columns[:2] != ["asset", "bar_ts"]:
            raise ValueError("a field package must give asset and bar_ts first")
        return made


@dataclass
class FeatureRegistry:
    """Families by name."""

    families: dict[str, FeatureFamily] = field(default_factory=dict)

    def register(self, family: FeatureFamily) -> None:
        self.families[family.name] = family

    def get(self, name: str) -> FeatureFamily:
        if name not in self.families:
            raise KeyError(f"no feature family {name}; known: {sorted(self.families)}")
        return self.families[name]

    def param_hash(self, name: str, params: Mapping[str, Any]) -> str:
        """Names a family's table: its name, version and parameters."""
        family = self.get(name)
        told = json.dumps([name, family.version, {**family.defaults, **params}], sort_keys=True, default=list)
        return hashlib.sha256(told.encode()).hexdigest()[:16]

    def compose(self, bars: DataFrame, sets: list[tuple[str, Mapping[str, Any]]]) -> DataFrame:
        """The features of several families side by side."""
        tables = [self.get(n).apply(bars, p) for n, p in sets]
        out = tables[0]
        for t in tables[1:]:
            out = out.join(t, ["asset", "bar_ts"])
        return out


def default_registry() -> FeatureRegistry:
    registry = FeatureRegistry()
    for family in (Baseline(), CrossAsset(), Regime(), FieldAdapter()):
        registry.register(family)
    return registry
