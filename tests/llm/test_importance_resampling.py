import hashlib
import math
import re
from collections import Counter
from zlib import crc32

from pyspark.sql import functions as F

from foldspark.llm import importance_resampling as r


def _features(text, longest=2):
    low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=25, least=20):
    """The contract, feature by feature."""
    bucket = lambda f: crc32(f.encode()) % 10_000
    s, t = Counter(), Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            side.update(map(bucket, _features(x)[1]))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    rows = []
    for key, text in docs:
        words, features = _features(text)
        weight = math.floor(sum(gain[bucket(f)] for f in features) / len(features)) if features else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= least])
    able = sorted((x for x in rows if x[5]), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted(map(str, (tuple(x[:5]) for x in rows)))


def _got(df):
    return sorted(str(tuple(x)) for x in df.collect())


def test_query_equals_counting_every_feature(spark):
    docs, target = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    assert _got(r.draw(docs, target)) == brute([(x.doc_id, x.text) for x in docs.collect()], [x.text for x in target.collect()])


def test_edge_cases(spark, edge, empty):
    more = spark.createDataFrame([(k, f"Wörter {k % 3} " * 30 + "Ünd\x00x ab-cd" * (k % 2), "x", "y") for k in range(40)] * 2, "doc_id long, text string, lang string, source string")
    docs = edge.unionByName(more, allowMissingColumns=True).withColumns({c: F.lit("z") for c in ("rank", "weight", "eligible", "bucket", "n", "gain")})
    target = spark.createDataFrame([("one ein satz",), (None,), ("",)], "text string")
    rows = [(x.doc_id, x.text) for x in docs.select("doc_id", "text").collect()]
    assert _got(r.draw(docs, target)) == brute(rows, ["one ein satz", None, ""])
    assert _got(r.draw(docs, target.limit(0))) == brute(rows, [])
    assert r.draw(empty, target).count() == 0


def test_one_scan_gives_the_checksum_of_every_run():
    text = ("The quick-brown Fox, 12 élan vital! " * 30).encode()
    for longest in (1, 2, 3, 5):
        parts = list(r.runs(text, longest))
        assert Counter(x for _, out in parts for x in out) == Counter(crc32(f.encode()) for f in _features(text.decode(), longest)[1])


def test_pieces_of_a_long_text(monkeypatch):
    text = ("ab cde, " * 500 + "x" * 300 + " y z" * 100).encode()
    whole = [list(r.runs(text, 3))]
    for piece in (1, 7, 64, 1000):
        monkeypatch.setattr(r, "PIECE", piece)
        whole.append(list(r.runs(text, 3)))
    flat = [([x for _, out in w for x in out], sum(n for n, _ in w)) for w in whole]
    assert len(whole[1]) > 50 and all(f == flat[0] for f in flat)


def test_ranks_do_not_depend_on_partitions(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("score"), (F.col("id") % 5 > 0).alias("eligible"))
    want = {d: k + 1 for k, (_, d) in enumerate(sorted((-(d % 7), d) for d in range(3000) if d % 5)[:600])}
    for parts in (1, 13):
        out = r.ranked(rows.repartition(parts), F.lit(600)).collect()
        assert len(out) == 3000 and {x.doc_id: x.rank for x in out if x.rank} == want
