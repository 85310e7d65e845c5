"""Small made-up bars, and comparison of results without regard to order."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

from foldspark.sources.bars import BARS, with_time_index

START = datetime(2024, 1, 1)


def bars(spark: SparkSession, closes: dict[str, dict[int, float]]) -> DataFrame:
    """Bars by asset and hour, with the time index; high and low are 1 around the close."""
    rows = [(a, START + timedelta(hours=t), c, c + 1, c - 1, c, 10.0 + t, 1) for a, series in closes.items() for t, c in series.items()]
    return with_time_index(spark.createDataFrame(rows, BARS))


def linear(spark: SparkSession, n: int = 60) -> DataFrame:
    return bars(spark, {"a": {t: 100.0 + t for t in range(n)}, "b": {t: 100.0 + t for t in range(n)}})


def cells(rows: list[dict], names: list[str]) -> list[tuple]:
    def cell(v: object) -> str:
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "-"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, (int, float)):
            return f"{float(v) + 0.0:.9g}"
        return str(v)

    return sorted(tuple(cell(r[n]) for n in names) for r in rows)
