import duckdb
import pytest
from pyspark.sql import functions as F
from test_models import WORD

from foldspark.llm import mixing


def oracle(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(map(repr, c.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({mixing.ORACLE})").fetchall()))


def queueing(rows):
    """Weighted fair queueing word by word: each queue's words have their virtual finish times,
    all of them are sorted and cut at the total budget."""
    import hashlib

    size = lambda t: len(WORD.findall(t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, left, target = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in target]
        over = [s for s in rest if left * weight[s] / sum(weight[r] for r in rest) > 2 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
    words = []
    for s in names:
        queue = sorted((r for r in range(len(rows)) if rows[r][2] == s), key=lambda r: (hashlib.md5(("" if rows[r][0] is None else str(rows[r][0])).encode()).hexdigest(), size(rows[r][1])))
        at = 0
        for _ in range(2):
            for r in queue:
                for _ in range(size(rows[r][1])):
                    at += 1
                    words.append((at / target[s], r))
    words.sort()
    taken = [0] * len(rows)
    for finish, r in words:
        if finish <= 1 + 1e-12:  # here the targets, and so the budget, are used up
            taken[r] += 1
    assert sum(target.values()) - len(names) <= sum(taken) <= sum(target.values()) + 1e-6
    return sorted((str(k), size(t), n) for (k, t, _), n in zip(rows, taken))


def test_same_as_the_schedule_word_by_word(spark, edge):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for df in (docs, edge.filter("length(text) < 1000 or text is null")):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        assert sorted((str(r["doc_id"]), r["size"], r["taken"]) for r in mixing.per_document(df).collect()) == queueing(rows)


@pytest.mark.parametrize("part,hot", [(2, 40_000), (2000, 3), (2000, 40_000)])
def test_same_as_sql(spark, edge, empty, monkeypatch, part, hot):
    monkeypatch.setattr(mixing, "PART_ROWS", part)
    monkeypatch.setattr(mixing, "HOT", hot)
    monkeypatch.setattr(mixing, "TOGETHER", 7)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 > 0, "src0").otherwise(F.col("source")))
    unnamed = hot.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).withColumn("text", F.when(F.col("doc_id").isNull(), "a b c").otherwise(F.col("text")))
    for df in (docs, hot, unnamed.repartition(5), edge, empty):
        rows = [tuple(r) for r in df.select("doc_id", "text", "source").collect()]
        got = [tuple(r) for r in mixing.per_document(df).collect()]
        assert sorted(map(repr, got)) == oracle(rows)


def test_shares(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.per_document(docs).withColumn("source", F.lit(None).cast("string")).drop("source").join(docs.select("doc_id", "source"), "doc_id").collect()
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    for s in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
    assert sum(r["taken"] for r in rows) == pytest.approx(1.5 * sum(r["size"] for r in rows), abs=40)


def test_targets_are_reshared_until_none_is_above(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(sizes).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx((3015 - 20) / 3) and got["c"] == pytest.approx((3015 - 20) * 2 / 3)


def test_mix_is_in_order_of_finish(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumns({c: F.lit("x") for c in ("pass", "words", "finish", "taken")})
    rows = mixing.mix(docs).collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows) and all(r["words"] > 0 for r in rows)


def test_no_python_on_the_main_path(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.per_document(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
