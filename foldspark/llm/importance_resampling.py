"""Target-distribution importance resampling over hashed n-grams of words.

Texts are lower-cased (A-Z); words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, and the
features all runs of 1 to ``longest`` words, joined by a space.  A feature's bucket is
its CRC-32 modulo ``buckets``.  One scan of a document keeps a ring with the running
checksum of the runs that began at each of the last ``longest`` words: a new word
extends each by a space and itself and starts one of its own, so no run is ever put
together, and each step emits the buckets of all runs that end there.  Texts are
scanned a piece at a time; the ring goes on from one to the next.

A bucket's gain compares its share of the target's features with its share of the
corpus's.  Gains are a table of ``buckets`` rows, whatever the size of the corpus.  A
document's weight is its features' mean gain; with Gumbel noise drawn from its id
the highest scores are a sample without replacement by weight.

Null texts have no words and weight 0.  Repeated rows count each time and get a row
each; among rows of equal score those with the smaller id, null first, come first.
An empty corpus gives an empty result; with an empty target each bucket's gain follows from
the corpus alone.  Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.llm.common import materialised, ready, with_computed
from foldspark.llm.textvec import raw_utf8

#: Bytes of a text that are scanned at a time (a word more where one lies across).
PIECE = 1 << 18

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def runs(text: bytes, longest: int) -> Iterator[tuple[int, list[int]]]:
    """(words, checksums of all runs that end at them) of the pieces of a text."""
    low, at, ring = text.translate(_LOWER), 0, []
    keep = longest - 1
    while at < len(low):
        found = _GAP.search(low, at + PIECE)
        end = found.start() if found else len(low)
        words, out = _WORD.findall(low, at, end), []
        for word in words:
            spaced = b" " + word
            ring = [crc32(word), *[crc32(spaced, state) for state in ring[:keep]]]
            out += ring
        yield len(words), out
        at = end


def _texts(column: pa.Array) -> Iterator[bytes]:
    buf, off = raw_utf8(column)
    raw = buf.data
    for i, j in zip(off[:-1].tolist(), off[1:].tolist()):
        yield raw[i:j].tobytes()


def bucket_counts(docs: DataFrame, longest: int = 2, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, n): how many features of all texts are in each bucket that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for one in _texts(batch.column(0)):
                for _, out in runs(one, longest):
                    held += np.bincount(np.array(out, np.int64) % buckets, minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["bucket", "n"])

    ready(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, longest: int = 2, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) for every bucket: a thousand times the log of the ratio of smoothed shares, rounded down."""
    s, t = (bucket_counts(x, longest, buckets).withColumnRenamed("n", c) for x, c in ((docs, "s"), (target, "t")))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"])
    sums = every.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets)
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets)
    return every.join(F.broadcast(sums)).select("bucket", F.floor(1000 * F.ln(up / down)).alias("gain"))  # ``sums`` is one row


def noise(key: Column, seed: str = "7") -> Column:
    """A thousand times a Gumbel variate, rounded down, from a document's id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def weighted(docs: DataFrame, table: DataFrame, longest: int = 2, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_features and weight (the mean gain, rounded down) in place of columns of these names."""
    told = np.zeros(buckets, np.int64)
    for row in table.collect():  # a row a bucket
        told[row["bucket"]] = row["gain"]

    def start():
        def apply(values: pa.Array) -> Iterator[list[pa.Array]]:
            rows = []
            for one in _texts(values):
                n_words = n = total = 0
                for words, out in runs(one, longest):
                    n_words, n = n_words + words, n + len(out)
                    total += int(told[np.array(out, np.int64) % buckets].sum())
                rows.append((n_words, n, total // n if n else 0))
            yield [pa.array(c, pa.int64()) for c in zip(*rows)]

        return apply

    return with_computed(docs, text, "n_words long, n_features long, weight long", start)


def ranked(rows: DataFrame, draw: Column, key: str = "doc_id") -> DataFrame:
    """``rows`` (a table that was written) with rank: 1, 2, 3... by score downwards of the first ``draw`` rows that are ``eligible``.

    How many rows lie above a score follows from the counts of scores, of which there are
    no more than there are integers between the smallest and the largest; rows are sorted only within a score.
    """
    counts = rows.filter("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    many = counts.agg(draw.alias("draw"))
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(above), F.lit(0))).join(F.broadcast(many)).filter(F.col("before") < F.col("draw"))
    both = rows.join(starts.select("score", "before", "draw").withColumn("eligible", F.lit(True)), ["score", "eligible"], "left")
    drawn = both.filter("before is not null")
    place = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first(key)))
    drawn = drawn.withColumn("rank", place.cast("long")).withColumn("rank", F.when(F.col("rank") <= F.col("draw"), F.col("rank")))
    rest = both.filter("before is null").withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select(*rows.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, longest: int = 2, buckets: int = 10_000, seed: str = "7") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, eligible, rank): ``percent`` of the documents with at least
    ``least_words`` words are drawn towards ``target`` (text) and have a rank."""
    ready(docs.sparkSession)
    table = gains(docs.select("text"), target.select("text"), longest, buckets)
    rows = weighted(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), table, longest, buckets).drop("text")
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("eligible", F.col("n_words") >= least_words)
    return ranked(materialised(scored), F.expr(f"({percent} * sum(n)) div 100"))


def draw(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(1, 9)), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) t(i))
), docs AS (SELECT row_number() OVER () AS row, 's' AS side, doc_id, text FROM documents UNION ALL SELECT row_number() OVER (), 't', NULL, text FROM benchmark),
worded AS (SELECT row, side, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM docs),
places AS (SELECT row, side, w, unnest(range(1, len(w) + 1)) AS i FROM worded WHERE len(w) > 0),
runs AS (SELECT row, side, w[i] AS f FROM places UNION ALL SELECT row, side, w[i] || ' ' || w[i + 1] FROM places WHERE i < len(w)),
feature AS (SELECT row, side, f, count(*) AS n FROM runs GROUP BY ALL),
names AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM feature)),
bytes AS (SELECT f, list_transform(range(0, len(h) // 2), lambda j: (strpos('0123456789ABCDEF', h[2 * j + 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * j + 2]) - 1) AS b FROM names),
crc AS (SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table),
bucketed AS (SELECT row, side, bucket, n FROM feature JOIN crc USING (f)),
counts AS (SELECT b.bucket, coalesce(sum(n) FILTER (side = 's'), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 't'), 0)::BIGINT AS t FROM range(10000) b(bucket) LEFT JOIN bucketed USING (bucket) GROUP BY b.bucket),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts),
sums AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM bucketed JOIN gain USING (bucket) WHERE side = 's' GROUP BY row),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM worded LEFT JOIN sums USING (row) WHERE side = 's'
), placed AS (SELECT *, row_number() OVER (ORDER BY n_words >= 20 DESC, score DESC, doc_id NULLS FIRST) AS r, count(*) FILTER (n_words >= 20) OVER () AS eligible FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= (25 * eligible) // 100 THEN r END AS rank FROM placed
"""
