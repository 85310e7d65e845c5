"""Vendors of historical bars behind one interface."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from foldspark.sources.bars import normalise


class Vendor(ABC):
    """Fetches raw rows; ``names`` maps columns of bars to the vendor's."""

    names: dict[str, str] = {}

    @abstractmethod
    def fetch(self, spark: SparkSession, assets: list[str] | None) -> DataFrame: ...

    def bars(self, spark: SparkSession, assets: list[str] | None = None) -> DataFrame:
        return normalise(self.fetch(spark, assets), self.names)


@dataclass
class ParquetVendor(Vendor):
    """Rows that lie in Parquet files; the filter on assets reaches the scan."""

    path: str
    names: dict[str, str] = field(default_factory=dict)

    def fetch(self, spark: SparkSession, assets: list[str] | None) -> DataFrame:
        rows = spark.read.parquet(self.path)
        return rows if assets is None else rows.filter(rows[self.names.get("asset", "asset")].isin(assets))


@dataclass
class TableVendor(Vendor):
    """Rows that a function gives, such as :func:`foldspark.sources.bars.event_bars`."""

    rows: Callable[[SparkSession], DataFrame]
    names: dict[str, str] = field(default_factory=dict)

    def fetch(self, spark: SparkSession, assets: list[str] | None) -> DataFrame:
        rows = self.rows(spark)
        return rows if assets is None else rows.filter(rows[self.names.get("asset", "asset")].isin(assets))


class WalkBars(DataSource):
    """A format of made-up bars for trials: ``spark.read.format("walk_bars")`` with
    options ``assets`` and ``bars``; each asset is one partition."""

    @classmethod
    def name(cls) -> str:
        return "walk_bars"

    def schema(self) -> str:
        return "asset string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double, n_trades bigint"

    def reader(self, schema) -> DataSourceReader:
        return _WalkReader(int(self.options.get("assets", 3)), int(self.options.get("bars", 100)))


class _WalkReader(DataSourceReader):
    def __init__(self, assets: int, bars: int):
        self.assets, self.bars = assets, bars

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(self.assets)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import random
        from datetime import datetime, timedelta

        rng, price, start = random.Random(partition.value), 100.0, datetime(2024, 1, 1)
        for k in range(self.bars):
            first = price
            price *= 1 + rng.gauss(0, 0.01)
            yield f"asset{partition.value}", start + timedelta(hours=k), first, max(first, price), min(first, price), price, 1000 * rng.random(), 1
