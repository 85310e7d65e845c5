"""Prediction tasks: forward-looking columns with the time at which their label is known."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.functions.features import by_asset, ratio, with_returns


def _whole(value: Column, made: Column, h: int) -> Column:
    """``made`` where all of the next ``h`` bars have a value."""
    return F.when(F.count(value).over(by_asset().rowsBetween(1, h)) == h, made)


def forward_return(h: int) -> Column:
    return ratio(F.lead("close", h).over(by_asset()), F.col("close")) - 1


def forward_volatility(h: int) -> Column:
    """Sample standard deviation of the next ``h`` one-bar returns."""
    return _whole(F.col("ret1"), F.stddev_samp("ret1").over(by_asset().rowsBetween(1, h)), h)


def up_down(h: int) -> Column:
    made = forward_return(h)
    return F.when(made.isNotNull(), (made > 0).cast("int"))


def max_upside(h: int) -> Column:
    return _whole(F.col("high"), ratio(F.max("high").over(by_asset().rowsBetween(1, h)), F.col("close")) - 1, h)


def max_drawdown(h: int) -> Column:
    """The lowest low against the entry's close."""
    return _whole(F.col("low"), ratio(F.min("low").over(by_asset().rowsBetween(1, h)), F.col("close")) - 1, h)


def peak_to_trough(h: int) -> Column:
    """The other reading of drawdown: the deepest fall from a running maximum of the next closes."""
    closes = F.collect_list("close").over(by_asset().rowsBetween(0, h))
    start = F.struct(F.lit(None).cast("double").alias("top"), F.lit(0.0).alias("worst"))

    def step(state: Column, c: Column) -> Column:
        top = F.greatest(state["top"], c)
        return F.struct(top.alias("top"), F.least(state["worst"], ratio(c, top) - 1).alias("worst"))

    return _whole(F.col("close"), F.aggregate(closes, start, step)["worst"], h)


@dataclass(frozen=True)
class PredictionTask:
    """What is predicted. Horizon is in bars of the asset, embargo on the shared time index."""

    name: str
    task_type: str
    horizon: int
    build_target: Callable[[int], Column] = field(compare=False)
    metrics: tuple[str, ...] = ("rmse", "ic")
    embargo: int = 0

    def __post_init__(self) -> None:
        if self.task_type not in ("regression", "classification"):
            raise ValueError(f"no task type {self.task_type}")
        if self.horizon < 1:
            raise ValueError("a horizon is at least one bar")

    def table(self, bars: DataFrame) -> DataFrame:
        """(asset, bar_ts, t_idx, y, label_end_ts, label_end_idx) from bars with ``t_idx``."""
        end = F.lead("t_idx", self.horizon).over(by_asset())
        return with_returns(bars).select(
            "asset",
            "bar_ts",
            "t_idx",
            self.build_target(self.horizon).cast("double").alias("y"),
            F.lead("bar_ts", self.horizon).over(by_asset()).alias("label_end_ts"),
            end.alias("label_end_idx"),
        )


@dataclass
class TaskRegistry:
    tasks: dict[str, PredictionTask] = field(default_factory=dict)

    def register(self, task: PredictionTask) -> None:
        self.tasks[task.name] = task

    def get(self, name: str) -> PredictionTask:
        if name not in self.tasks:
            raise KeyError(f"no task {name}; known: {sorted(self.tasks)}")
        return self.tasks[name]


def default_tasks(horizons: tuple[int, ...] = (5, 20, 40)) -> TaskRegistry:
    registry = TaskRegistry()
    for h in horizons:
        registry.register(PredictionTask(f"ret{h}", "regression", h, forward_return))
        registry.register(PredictionTask(f"vol{h}", "regression", h, forward_volatility))
        registry.register(PredictionTask(f"updown{h}", "classification", h, up_down, ("log_loss", "auc", "brier")))
        registry.register(PredictionTask(f"max_upside{h}", "regression", h, max_upside))
        registry.register(PredictionTask(f"max_drawdown{h}", "regression", h, max_drawdown))
    return registry
