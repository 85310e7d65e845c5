import numpy as np

from foldspark.llm import components as c


def _expected(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_stars_of_a_path_and_random_links():
    rng = np.random.default_rng(3)
    for edges in ([(k, k + 1) for k in range(200)], rng.integers(-300, 300, (250, 2)).tolist(), [(5, 5)], []):
        u, v = (np.array([e[k] for e in edges], np.int64) for k in (0, 1))
        got = dict(zip(*(x.tolist() for x in c.stars(u, v))))
        assert got == {x: r for x, r in _expected(edges).items() if x != r}


def test_components_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(c, "CHUNK", 64)
    rng = np.random.default_rng(4)
    path = np.stack([np.arange(400), np.arange(1, 401)], 1) + 10_000
    hub = np.stack([np.full(300, 20_000), np.arange(300) + 20_001], 1)
    edges = np.concatenate([rng.permutation(path), hub, rng.integers(0, 2_000, (900, 2))]).tolist()
    got = {r.id: r.component for r in c.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == _expected(edges)


def test_no_links(spark):
    assert c.components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert c.components(spark.createDataFrame([(4, 4)], "u long, v long")).count() == 0


def test_a_logistic_fit_after_components(spark):
    """Nothing that components leave behind may keep the session's models from reaching executors."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    c.components(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")).count()
    rows = spark.createDataFrame([(Vectors.dense([float(k)]), float(k % 3 > 0)) for k in range(30)], ["features", "label"])
    assert LogisticRegression().fit(rows).transform(rows).count() == 30
