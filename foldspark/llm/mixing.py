"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents queue in shuffled order (by the MD5 of their id); the queue
may be served more than once.  The virtual time at which a document is begun or
finished is the source's words up to its begin or end divided by the source's target,
so a source whose target is larger is served faster.  The mix is the schedule in the
order of these times, cut where the total budget is used up: every queue runs at the
speed of its target and the targets add up to the budget, so that is at the virtual
time 1, and a document that is in service then is cut at that word.  (Truncating
whole documents instead would leave a source that has few, long ones far from its
target.)

Null and empty texts have 0 words, join the queue and take nothing.  A null source
is a source of its own, the last.  Repeated rows queue one after the other; rows
that are equal in id, source and size may change places, which changes no result.
An empty table gives no rows.  Columns that the functions make replace those of the
same names.

A hot source is no hot task: queues are cut into parts by the first digits of the
MD5, sums of parts are added up first, in two levels, and only a part's rows are
sorted together.  A part with more than ``HOT`` rows has many rows of one id, or of
none; there, equal ids and sizes are counted by input partition first, and only
rows of one id, size and partition are numbered together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import materialised, ready

#: Rows that a part of a queue is meant to hold.
PART_ROWS = 2_000
#: Rows of a part from which on its repeated ids are split, and parts whose sums are added up together.
HOT, TOGETHER = 40_000, 1_000


def words(text: str | Column) -> Column:
    """Number of maximal runs of bytes other than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes`` (source, source_size) with weight, cap and target.

    The budget, ``share`` of all words, is shared by weight; what exceeds ``most``
    times a source's size is shared again among the others until none is above.
    Where that ends has a closed form: with sources in the order of cap/weight,
    those up to some place get their cap, all others the same multiple of their weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    after = everything.rowsBetween(0, Window.unboundedFollowing)
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("_n", F.row_number().over(by_name) - 1)
        .withColumn("weight", pick)
        .withColumn("_cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("_ratio", F.col("_cap") / F.col("weight"))
        .withColumn("_budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("_level", F.try_divide(F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), F.sum("weight").over(after)))
        .withColumn("_fits", F.col("_level") <= F.col("_ratio"))
        .withColumn("_rate", F.min(F.when(F.col("_fits"), F.struct("_ratio", "source", "_level"))).over(whole)["_level"])
        .withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("weight") * F.col("_rate"), F.col("_cap"))))
        .select("source", "source_size", "weight", "_n", "target")
    )


def _served(size: Column, begin: Column, target: Column) -> Column:
    """Words of a document served by the virtual time 1: all if it is finished then, none if it is not begun."""
    return F.when(begin + size <= target, size).when(begin < target, F.floor(target) - begin).otherwise(F.lit(0)).cast("long")


def schedule(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``docs`` with size, source_size, target, start (words queued before it, first pass) and taken.

    Columns of ``docs`` with one of these names are replaced.
    """
    ready(docs.sparkSession)
    made = ["size", "source_size", "target", "start", "taken"]
    others = [c for c in docs.columns if c not in made]
    n = max(1, -(-docs.count() // PART_ROWS))
    hashed = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")))
    rows = docs.select(
        *others,
        words(text).alias("size"),
        F.col(source).alias("_source"),
        F.col(key).alias("_key"),
        hashed.alias("_order"),
        F.shiftright(F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") * n, 32).alias("_part"),
        F.spark_partition_id().alias("_salt"),
    )
    parts = materialised(rows.groupBy("_source", "_part").agg(F.sum("size").alias("_words"), F.count(F.lit(1)).alias("_rows")))
    known = targets(parts.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")), weights, share, most)
    before = _before(parts).join(known.withColumnRenamed("source", "_known"), F.col("_source").eqNullSafe(F.col("_known")))
    before = before.select(F.col("_source").alias("_at"), F.col("_part").alias("_in"), "_before", "source_size", "target")
    within = Window.partitionBy("_source", "_part").orderBy("_order", F.col("_key").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    sums = lambda of: of.withColumn("_queued", F.coalesce(F.sum("size").over(within), F.lit(0)))
    hot = parts.filter(F.col("_rows") > HOT).select(F.col("_source").alias("_at"), F.col("_part").alias("_in"))
    if hot.isEmpty():
        queued = sums(rows)
    else:
        same = F.col("_source").eqNullSafe(F.col("_at")) & (F.col("_part") == F.col("_in"))
        queued = sums(rows.join(hot, same, "left_anti")).unionByName(_split(rows.join(hot, same, "left_semi")))
    begin = F.col("start")
    taken = sum((_served(F.col("size"), begin + p * F.col("source_size"), F.col("target")) for p in range(_passes(most))), F.lit(0))
    return (
        queued.join(before, F.col("_source").eqNullSafe(F.col("_at")) & (F.col("_part") == F.col("_in")))
        .withColumn("start", F.col("_before") + F.col("_queued"))
        .withColumn("taken", taken.cast("long"))
        .select(*others, *made)
    )


def _passes(most: float) -> int:
    return -(-int(most * 1000) // 1000)


def _before(parts: DataFrame) -> DataFrame:
    """``parts`` with the words of their source's parts before them: sums of many parts first, then inside those."""
    wide = parts.withColumn("_many", F.floor(F.col("_part") / TOGETHER))
    up_to = lambda w: F.coalesce(F.sum("_words").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    above = wide.groupBy(F.col("_source").alias("_s"), F.col("_many").alias("_m")).agg(F.sum("_words").alias("_words"))
    above = above.select("_s", "_m", up_to(Window.partitionBy("_s").orderBy("_m")).alias("_above"))
    inside = wide.withColumn("_inside", up_to(Window.partitionBy("_source", "_many").orderBy("_part")))
    both = inside.join(above, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_many") == F.col("_m")))
    return both.select("_source", "_part", (F.col("_above") + F.col("_inside")).alias("_before"))


def _split(rows: DataFrame) -> DataFrame:
    """``rows`` of hot parts with the words queued before them in their part."""
    names = ["_source", "_part", "_order", "_key", "size", "_salt"]
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy("_source", "_part").orderBy("_order", F.col("_key").asc_nulls_last(), "size", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("_ahead", F.coalesce(F.sum(F.col("size") * F.col("_n")).over(order), F.lit(0)))
    groups = groups.select(*(F.col(c).alias(f"_g{c}") for c in names), "_ahead")
    numbered = rows.withColumn("_r", F.row_number().over(Window.partitionBy(*names).orderBy("_order")) - 1)
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_g{c}"))
    return numbered.join(groups, same).withColumn("_queued", F.col("_ahead") + F.col("_r") * F.col("size")).select(*rows.columns, "_queued")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, **columns: str) -> DataFrame:
    """The mix itself: a row for each time a document is served, in the order of virtual
    finish times (globally range-sorted), with ``words`` taken from it that time.

    Columns of ``docs`` named pass, words or finish are replaced, like those of :func:`schedule`.
    """
    rows = schedule(docs, weights, share, most, **columns).drop("pass", "words", "finish")
    served = rows.withColumn("pass", F.explode(F.array(*map(F.lit, range(_passes(most))))))
    begin = F.col("start") + F.col("pass") * F.col("source_size")
    return (
        served.withColumn("words", _served(F.col("size"), begin, F.col("target")))
        .filter("words > 0")
        .withColumn("finish", (begin + F.col("words")) / F.col("target"))
        .orderBy("finish", F.col(columns.get("key", "doc_id")))
    )


def per_document(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return schedule(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap,
         CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget
  FROM s),
o AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
            / sum(weight) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM w WINDOW b AS (ORDER BY cap / weight, source ASC NULLS LAST)),
r AS (SELECT arg_min(level, cap / weight) AS rate FROM o WHERE level <= cap / weight),
t AS (SELECT source, source_size, least(cap, coalesce(weight * rate, cap)) AS target FROM o LEFT JOIN r ON true),
q AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, floor(target) - start)) + greatest(0, least(size, floor(target) - start - source_size)) AS BIGINT) AS taken
FROM q
"""
