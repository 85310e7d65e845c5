"""Plots of diagnostics as SVG text: aggregated by Spark, drawn from a bounded number of points."""

from __future__ import annotations

from collections.abc import Sequence
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.sources import files

#: Points of a line, and bins of a histogram.
POINTS, BINS = 500, 40
WIDTH, HEIGHT, EDGE = 720, 300, 46
COLOURS = ("#3367b1", "#c1532f", "#4a8f54", "#8a5aa8", "#a8892c")


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, low, high, n) of a column between its extremes; NULLs and NaNs do not count."""
    used = df.select(F.col(column).cast("double").alias("x")).filter("x is not null and not isnan(x)")
    ends = used.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / width), F.lit(bins - 1))).otherwise(0).cast("int")
    counts = used.crossJoin(ends).groupBy(at.alias("bin"), "a", "b").agg(F.count(F.lit(1)).alias("n"))  # one row of extremes
    return counts.select("bin", (F.col("a") + F.col("bin") * width).alias("low"), (F.col("a") + (F.col("bin") + 1) * width).alias("high"), "n")


def series(df: DataFrame, x: str, y: str, by: str | None = None, points: int = POINTS) -> DataFrame:
    """(by, x, y): means of ``y`` in at most ``points`` stretches of the numeric column ``x`` for each line."""
    keys = [F.col(by).cast("string").alias("line") if by else F.lit("").alias("line")]
    used = df.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x is not null and y is not null")
    ends = used.agg(F.min("x").alias("a"), F.max("x").alias("b"))
    at = F.when(F.col("b") > F.col("a"), F.least(F.floor((F.col("x") - F.col("a")) / (F.col("b") - F.col("a")) * points), F.lit(points - 1))).otherwise(0)
    return used.crossJoin(ends).groupBy("line", at.alias("at")).agg(F.avg("x").alias("x"), F.avg("y").alias("y")).drop("at")


def _frame(title: str, xs: Sequence[float], ys: Sequence[float], inside: list[str]) -> str:
    labels = [
        f'<text x="{WIDTH / 2}" y="18" text-anchor="middle">{escape(title)}</text>',
        f'<text x="{EDGE}" y="{HEIGHT - 12}">{min(xs):.4g}</text><text x="{WIDTH - EDGE}" y="{HEIGHT - 12}" text-anchor="end">{max(xs):.4g}</text>',
        f'<text x="4" y="{HEIGHT - EDGE}">{min(ys):.4g}</text><text x="4" y="{EDGE}">{max(ys):.4g}</text>',
        f'<rect x="{EDGE}" y="{EDGE - 16}" width="{WIDTH - 2 * EDGE}" height="{HEIGHT - 2 * EDGE + 16}" fill="none" stroke="#999"/>',
    ]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{WIDTH}" height="{HEIGHT}" font-family="sans-serif" font-size="12">{"".join(labels + inside)}</svg>'


def _scale(values: Sequence[float], low: float, high: float):
    a, b = min(values), max(values)
    return lambda v: low + (high - low) * ((v - a) / (b - a) if b > a else 0.5)


def lines_svg(points: DataFrame, title: str) -> str:
    """Lines of :func:`series`; an empty plot where there are no points."""
    rows = sorted((r["line"], r["x"], r["y"]) for r in points.limit(POINTS * len(COLOURS)).collect())
    xs, ys = [r[1] for r in rows] or [0.0], [r[2] for r in rows] or [0.0]
    sx, sy = _scale(xs, EDGE, WIDTH - EDGE), _scale(ys, HEIGHT - EDGE, EDGE)
    inside = []
    for k, name in enumerate(sorted({r[0] for r in rows})):
        colour = COLOURS[k % len(COLOURS)]
        path = " ".join(f"{sx(x):.1f},{sy(y):.1f}" for n, x, y in rows if n == name)
        inside.append(f'<polyline fill="none" stroke="{colour}" points="{path}"/><text x="{WIDTH - EDGE + 4}" y="{EDGE + 14 * k}" fill="{colour}">{escape(name)}</text>')
    return _frame(title, xs, ys, inside)


def histogram_svg(counts: DataFrame, title: str) -> str:
    """Bars of :func:`histogram`."""
    rows = sorted((r["low"], r["high"], r["n"]) for r in counts.collect())
    xs, ys = [v for r in rows for v in r[:2]] or [0.0], [0, *(r[2] for r in rows)]
    sx, sy = _scale(xs, EDGE, WIDTH - EDGE), _scale(ys, HEIGHT - EDGE, EDGE)
    inside = [f'<rect x="{sx(a):.1f}" y="{sy(n):.1f}" width="{max(sx(b) - sx(a) - 1, 1):.1f}" height="{sy(0) - sy(n):.1f}" fill="{COLOURS[0]}"/>' for a, b, n in rows]
    return _frame(title, xs, ys, inside)


def save(df: DataFrame, svg: str, path: str) -> None:
    """Writes a plot where Spark can write."""
    files.write_text(df.sparkSession, path, svg)
