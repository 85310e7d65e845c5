"""Connected components by alternating stars, without collecting links anywhere.

Each round starts by turning the links of a task into stars to their smallest ids, at
most ``CHUNK`` links at a time.  Tasks are as many as that takes, at every size, so a
task's share stays the same and the rounds get fewer by what tasks settle themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldspark.llm.common import materialised

#: Links that a task holds at a time.
CHUNK = 1 << 15


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, the smallest id each is linked to, directly or by others) but for those that are it."""
    ids, flat = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    far = root != np.arange(len(ids))
    return ids[far], ids[root[far]]


def _settled(links: DataFrame) -> DataFrame:
    """``links`` (u, v) with the links of each chunk as stars."""

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(u, v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CHUNK:
                yield star(held)
                held = []
        if held:
            yield star(held)

    return links.mapInArrow(run, "u long, v long")


def _star(both: DataFrame) -> DataFrame:
    """Every row (u, v) with m, the smallest among u and all its v. A hub's rows are
    aggregated before they move, and joined back by a join whose hot side Spark can split."""
    least = both.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")).select("w", F.least("w", "m").alias("m"))
    return both.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def _state(links: DataFrame) -> tuple[int, int]:
    """Number and checksum of the links of a written table."""
    n, total = links.agg(F.count(F.lit(1)), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
    return n, int(total or 0)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(id, component) for every id in ``edges`` (u, v); a component is named by its smallest id."""
    now = materialised(edges.filter("u <> v").distinct())
    state = _state(now)
    for _ in range(most_rounds):
        now = _settled(now.coalesce(-(-state[0] // CHUNK) or 1))
        if state[0] <= CHUNK:  # one task held all links, so nothing is left to settle
            now = materialised(now, free=False)
            break
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        starred = _star(down)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(starred.select("u", F.col("m").alias("v")))
        now = materialised(small.filter("u <> v").distinct(), free=False)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
