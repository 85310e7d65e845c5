"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a hash by which the rows of a label are counted before its sample is ranked.
BITS = 16


def text_labels(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(h, label) of the texts of ``docs`` whose key ``known`` (key, label) has; texts do not move."""
    return docs.select(key, F.xxhash64(text).alias("h")).join(known.select(key, "label"), key).select("h", "label")


def labelled_sample(docs: DataFrame, pairs: DataFrame, per_label: int, text: str = "text") -> DataFrame:
    """(h, text, label): at most ``per_label`` different texts of each label, the same ones each time.

    ``pairs`` has (h, label) by hash of the text.  Only hashes are ranked; the texts
    chosen are looked up by a broadcast of at most ``per_label`` rows a label.
    """
    # Hashes are counted in ranges first; only those up to the range that fills the sample are ranked,
    # so a frequent label is no hot task.
    picks = pairs.filter("label is not null").distinct().withColumn("range", F.shiftright("h", 64 - BITS))
    counts = picks.groupBy("label", "range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("label").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    wanted = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(F.col("before") < per_label).select("label", "range")
    by = Window.partitionBy("label").orderBy("h")
    picks = picks.join(wanted, ["label", "range"]).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= per_label).select("h", "label")
    hashed = docs.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    return hashed.join(F.broadcast(picks), "h").dropDuplicates(["h", "label"]).select("h", "text", "label")
