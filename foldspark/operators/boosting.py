"""Gradient boosted trees of all folds at once, by histograms.

Inputs are cut at exact quantiles of the fold's training rows once.  A level of a tree is one pass:
rows are scored by the trees so far, placed in the nodes of the tree that grows, and their gradients are
added up by (fold, node, feature, bin), partly before they move.  Each fold's splits are then chosen where its sums
are.  What is kept between passes is a row a fold with its trees; no row of data is written again.

Squared loss for regression, log loss for classes 0 and 1 with Newton leaves.  A tree is a heap: the children of
node i are 2i + 1 (values up to the threshold) and 2i + 2.  Equal gains go to the first feature and the lowest threshold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators import order
from foldspark.operators.lineage import cut

PARAMS = ("maxIter", "maxDepth", "maxBins", "stepSize", "minInstancesPerNode")
_TREE = "struct<feature: array<int>, bin: array<int>, threshold: array<double>, value: array<double>>"


def _node(tree: Column, goes_right, depth: int) -> Column:
    """Where a row ends in a tree of at most ``depth`` levels; ``goes_right(feature, node)`` tells for a split."""

    def down(node: Column, _: Column) -> Column:
        feature = F.get(tree["feature"], node)
        return F.when(feature >= 0, 2 * node + 1 + goes_right(feature, node).cast("int")).otherwise(node)

    return F.aggregate(F.array_repeat(F.lit(0), depth), F.lit(0), down)


def _scores(trees: Column, base: Column, step: float, goes_right, depth: int) -> Column:
    def add(total: Column, tree: Column) -> Column:
        return total + F.get(tree["value"], _node(tree, lambda f, n: goes_right(tree, f, n), depth))

    return base + step * F.aggregate(trees, F.lit(0.0), add)


def _grown(sums: pd.DataFrame, tree: dict, edges: list[list[float]], level: int, last: bool, least: int) -> dict:
    """The tree with the nodes of ``level`` split where that gains; sums has node, feature, bin, g, h, n."""
    tree = {k: list(v) for k, v in tree.items()}
    for node, own in sums.groupby("node"):
        if not 2**level - 1 <= node < 2 ** (level + 1) - 1:
            continue
        best = (1e-12, -1, -1, None)
        for f, by in own.sort_values(["feature", "bin"]).groupby("feature"):
            g, h, n = (by[c].to_numpy().cumsum() for c in ("g", "h", "n"))
            left, bins = slice(0, len(by) - 1), by.bin.to_numpy()[:-1]
            able = (n[left] >= least) & (n[-1] - n[left] >= least) & (h[left] > 1e-12) & (h[-1] - h[left] > 1e-12)
            if not able.any():
                continue
            gl, hl = np.where(able, g[left], 0.0), np.where(able, h[left], 1.0)
            hr = np.where(able, h[-1] - h[left], 1.0)
            gain = np.where(able, gl**2 / hl + (g[-1] - gl) ** 2 / hr - g[-1] ** 2 / max(h[-1], 1e-12), -np.inf)
            i = int(np.argmax(gain > gain.max() - 1e-9 * (1 + abs(gain.max()))))
            if gain[i] > best[0] * (1 + 1e-9):
                best = (float(gain[i]), int(f), int(bins[i]), (gl[i] / hl[i], (g[-1] - gl[i]) / hr[i]))
        if best[1] >= 0:
            tree["feature"][node], tree["bin"][node], tree["threshold"][node] = best[1], best[2], edges[best[1]][best[2]]
            tree["value"][2 * node + 1], tree["value"][2 * node + 2] = map(float, best[3])
    return tree


def fit(train: DataFrame, features: Sequence[str], keys: Sequence[str], params: Mapping[str, Any], classes: bool = False, y: str = "y") -> DataFrame:
    """(keys, n_train, intercept, coefs, trees): ``coefs`` are the features' shares of all splits."""
    rounds, depth, bins = int(params.get("maxIter", 20)), int(params.get("maxDepth", 5)), int(params.get("maxBins", 32))
    step, least, keys, p = float(params.get("stepSize", 0.1)), int(params.get("minInstancesPerNode", 1)), list(keys), len(features)
    used = train.dropna(subset=[*features, y]).select(*keys, *(F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)), F.col(y).cast("double").alias("_y"))
    long = used.unpivot(keys, [f"_x{i}" for i in range(p)], "_f", "_v")
    # Borders at shares of the rows; a value that takes several shares is one border.
    borders = order.quantiles(long, [*keys, "_f"], "_v", [i / bins for i in range(1, bins)], "_q").withColumn("_q", F.array_distinct("_q"))
    edges = borders.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_f", "_q"))).alias("_m")).select(*keys, F.array(*(F.col("_m")[f"_x{i}"] for i in range(p))).alias("edges"))
    mean = F.avg("_y")
    start = F.ln((F.sum("_y") + 0.5) / (F.count("_y") - F.sum("_y") + 0.5)) if classes else mean
    size = 2 ** (depth + 1) - 1
    empty = F.struct(F.array_repeat(F.lit(-1), size).alias("feature"), F.array_repeat(F.lit(-1), size).alias("bin"), F.array_repeat(F.lit(0.0), size).alias("threshold"), F.array_repeat(F.lit(0.0), size).alias("value"))
    state = cut(used.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_train"), start.alias("base")).join(edges, keys).select(*keys, "n_train", "base", "edges", F.array().cast(f"array<{_TREE}>").alias("trees"), empty.cast(_TREE).alias("tree")))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema)
    names = state.columns

    def bin_of(i: int) -> Column:
        return F.size(F.filter(F.col("edges")[i], lambda e: e < F.col(f"_x{i}")))

    place = F.array(*map(bin_of, range(p)))
    binned = cut(used.join(state.select(*keys, "edges"), keys).select(*keys, place.alias("_b"), "_y"))

    def grow(level: int):
        last = level == depth - 1

        def run(_, sums: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            row = held.iloc[0]
            tree = {k: list(row["tree"][k]) for k in ("feature", "bin", "threshold", "value")}
            tree = _grown(sums, tree, [list(e) for e in row["edges"]], level, last, least)
            trees = list(row["trees"])
            if last:
                trees, tree = [*trees, tree], {"feature": [-1] * size, "bin": [-1] * size, "threshold": [0.0] * size, "value": [0.0] * size}
            made = {**row.to_dict(), "trees": trees, "tree": tree}
            return pd.DataFrame([[made[c] for c in names]], columns=names)

        return run

    for _ in range(rounds):
        for level in range(depth):
            both = binned.join(state.select(*keys, "base", "trees", "tree"), keys)
            score = _scores(F.col("trees"), F.col("base"), step, lambda t, f, n: F.get(F.col("_b"), f) > F.get(t["bin"], n), depth)
            node = _node(F.col("tree"), lambda f, n: F.get(F.col("_b"), f) > F.get(F.col("tree")["bin"], n), level) if level else F.lit(0)
            prob = 1 / (1 + F.exp(-score))
            g, h = (F.col("_y") - prob, prob * (1 - prob)) if classes else (F.col("_y") - score, F.lit(1.0))
            told = both.select(*keys, node.alias("node"), g.alias("g"), h.alias("h"), "_b").select(*keys, "node", "g", "h", F.posexplode("_b").alias("feature", "bin"))
            sums = told.groupBy(*keys, "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
            state = cut(cut(sums).groupBy(*keys).cogroup(state.groupBy(*keys)).applyInPandas(grow(level), kinds))
    splits = F.filter(F.flatten(F.transform("trees", lambda t: t["feature"])), lambda f: f >= 0)

    def share(i: int) -> Column:
        return F.coalesce(F.try_divide(F.size(F.filter(splits, lambda f: f == i)), F.size(splits)), F.lit(0.0))

    return state.select(*keys, "n_train", F.col("base").alias("intercept"), F.array(*map(share, range(p))).alias("coefs"), "trees", F.lit(step).alias("step"), F.lit(depth).alias("depth"))


def score(features: Sequence[str]) -> Column:
    """Of rows that carry a fold's trees."""
    x = F.array(*(F.col(f).cast("double") for f in features))

    def add(total: Column, tree: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            f = F.get(tree["feature"], node)
            return F.when(f >= 0, 2 * node + 1 + (F.get(x, f) > F.get(tree["threshold"], node)).cast("int")).otherwise(node)

        return total + F.get(tree["value"], F.aggregate(F.array_repeat(F.lit(0), F.col("depth")), F.lit(0), down))

    return F.col("intercept") + F.col("step") * F.aggregate("trees", F.lit(0.0), add)


def probability(features: Sequence[str]) -> Column:
    return 1 / (1 + F.exp(-score(features)))
