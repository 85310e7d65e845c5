import numpy as np
import pytest

from foldspark.llm import ann
from foldspark.llm.common import ready, shared_uri

SF = "/root/testdata/sf0.01"


def brute(ids, x, k=20):
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


def rows_of(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_scores(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    data = table.orderBy("vec_id").toPandas()
    want = brute(data.vec_id.to_numpy(), np.array([np.array(v, float) for v in data.embedding]))
    got = rows_of(ann.nearest(table))
    assert set(got) == set(want)
    hits = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]
    assert np.mean(hits) >= 0.95
    for q in got:
        score = dict(zip(data.vec_id, np.array([np.array(v, float) for v in data.embedding]) @ np.array(data.embedding[data.vec_id == q].iloc[0], float)))
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda x: (-x[1], x[0]))


def test_several_shards_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)) * rng.uniform(0.5, 2, (900, 1))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    from pyspark.sql import functions as F

    rows = table.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    ready(spark)
    uri, queries = shared_uri(spark), rows.filter("id % 20 = 0")
    shards = ann.index(ann.nodes(rows, 20, shard_rows=200), queries.select("vector"), uri)
    assert shards.count() == 5 and all(r["recall"] >= ann.TARGET for r in shards.collect())
    found = ann.search(shards, queries, uri, 20, block=10)
    got = rows_of(found.withColumnRenamed("id", "vec_id"))
    want = brute(np.arange(900), x)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.95


@pytest.mark.parametrize("kind", ["gaussian", "lognormal", "clusters"])
def test_beam_is_as_wide_as_the_data_need(kind):
    rng = np.random.default_rng(6)
    n = 8192
    x = rng.normal(size=(n, 128 if kind == "gaussian" else 64))
    if kind == "lognormal":
        x *= rng.lognormal(0, 1, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "clusters":
        x = rng.normal(size=(100, 64))[rng.integers(0, 100, n)] + 0.3 * x
    graph = ann.Graph(x).build()
    beam, told = ann.measured(graph, x, x[:128], 20)
    q = x[1000:1200]
    want = ann.exactly(x, q, 21)
    found = want if beam == ann.EXACT else graph.search(ann._lifted(q), beam)[0]
    recall = np.mean([np.isin(w, f).mean() for w, f in zip(want, found)])
    assert recall >= 0.95 and told >= ann.TARGET


def test_same_id_with_several_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [0.5, 0.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])]
    got = rows_of(ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    assert got == {0: [(2, 1.0), (1, 0.5)]}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.0]) for i in range(0, 60)] + [(60, [0.0, 1.0]), (100, None), (120, [0.0, 0.0]), (140, [nan, 1.0]), (160, [inf, 1.0]), (180, []), (200, [1.0, None]), (220, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (20, [1.0, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = rows_of(ann.nearest(table))
    assert set(got) == {0, 20, 40, 60}
    assert [i for i, _ in got[0]] == list(range(1, 21)) and [i for i, _ in got[20]] == [*range(0, 20), 21][:20]
    assert [i for i, _ in got[60]] == list(range(20)) and all(s == 0 for _, s in got[60])
    assert rows_of(ann.nearest(table.limit(0))) == {}
    few = rows_of(ann.nearest(table.filter("vec_id in (0, 1, 2)")))
    assert [i for i, _ in few[0]] == [1, 2]


def test_shards_that_no_query_measures_are_searched_exactly(spark):
    """Vectors of a length of which no query is sampled have no measured recall."""
    rng = np.random.default_rng(9)
    short, long = rng.normal(size=(400, 8)), rng.normal(size=(300, 12))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(short)] + [(1000 + k, v.tolist()) for k, v in enumerate(long)], "id long, vector array<double>")
    sample = rows.filter("id < 400").select("vector")
    uri = ann.shared_uri(spark)
    shards = ann.index(ann.nodes(rows, 5), sample, uri, 5)
    beams = {r.d: r.beam for r in shards.collect()}
    assert beams[12] == ann.EXACT
    found = ann.search(shards, rows.filter("id >= 1000 and id % 50 = 0"), uri, 5).collect()
    for q in range(1000, 1300, 50):
        score = long @ long[q - 1000]
        want = [k + 1000 for k in np.argsort(-score) if k + 1000 != q][:5]
        assert [r.id for r in sorted((r for r in found if r.query_id == q), key=lambda r: r["rank"])] == want
