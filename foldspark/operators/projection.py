"""Fold-level diagnostics as row-level features, only once they are known.

A diagnostic holds from the first time after its ``known_at`` to that of the next.
The next one's start is looked up in the small table, so rows meet at most one
interval by a range join and are neither grouped nor sorted again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspark.operators.folds import bounded


def project_asof(rows: DataFrame, diagnostics: DataFrame, values: list[str], lag_folds: int = 0, by: str | None = None) -> DataFrame:
    """``rows`` with each diagnostic's latest value known before ``t_idx``, and ``has_health``.

    ``diagnostics`` has known_at, the values, and ``by`` (such as asset) if they are
    kept apart.  ``lag_folds`` waits for so many newer diagnostics on top.  Rows
    without a known value stay, with NULLs.
    """
    over = Window.partitionBy(by).orderBy("known_at") if by else Window.orderBy("known_at")
    one = Window.partitionBy(*([by] if by else []), "known_at").orderBy(F.desc("outer_fold_id"))
    spans = diagnostics.withColumn("_r", F.row_number().over(one)).filter("_r = 1")
    spans = spans.select(
        *([F.col(by).alias("_by")] if by else []),
        F.lead("known_at", lag_folds).over(over).alias("_from") if lag_folds else F.col("known_at").alias("_from"),
        F.lead("known_at", lag_folds + 1).over(over).alias("_until"),
        *(F.col(v).alias(f"_v_{v}") for v in values),
    ).filter("_from is not null")
    known = (F.col("_from") < F.col("t_idx")) & (F.col("_until").isNull() | (F.col("t_idx") <= F.col("_until")))
    if by:
        known = known & (F.col(by) == F.col("_by"))
    # Without ``by`` there is a row for each fold at most, which is broadcast if they are few.
    out = rows.join(spans if by else bounded(spans), known, "left")
    return out.select(*rows.columns, *(F.col(f"_v_{v}").alias(v) for v in values), F.col("_from").isNotNull().cast("int").alias("has_health"))
