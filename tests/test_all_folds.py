"""Models and curves that are fitted for all folds at once."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from foldspark.operators import boosting, calibration, logistic, order


def _classes(n, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * [3.0, 0.01] + [100.0, -5.0]
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.5 * (x[:, 0] - 100) - 60 * (x[:, 1] + 5) - 0.4)))).astype(float)
    return pd.DataFrame({"k": seed, "a": x[:, 0], "b": x[:, 1], "y": y})


def test_logistic_of_several_folds(spark):
    """Each fold's gradient is zero, and without the penalty on the intercept it is MLlib's optimum."""
    data = pd.concat([_classes(400, 1), _classes(90, 2), _classes(35, 3)])
    rows = spark.createDataFrame(data).unionByName(spark.createDataFrame([(1, None, 1.0, 1.0), (1, 1.0, 1.0, None)], "k long, a double, b double, y double"))
    for alpha in (0.0, 0.05):
        fits = {r.k: r for r in logistic.fit(rows, ["a", "b"], ["k"], alpha).collect()}
        for k, d in data.groupby("k"):
            f, x, y = fits[k], d[["a", "b"]].to_numpy(), d.y.to_numpy()
            assert f.converged and f.n_train == len(d) and f.rounds < 15
            s = x.std(0, ddof=1)
            gap = y - 1 / (1 + np.exp(-(f.intercept + x @ np.array(f.coefs))))
            g = ((x - x.mean(0)) / s).T @ gap - alpha * len(d) * np.array(f.coefs) * s
            assert abs(gap.sum()) < 1e-6 and np.abs(g).max() < 1e-6
        vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows.filter("k = 1 and a is not null and y is not null"))
        model = LogisticRegression(labelCol="y", regParam=alpha, tol=1e-12, maxIter=500).fit(vec)
        assert fits[1].coefs == pytest.approx(model.coefficients.toArray(), rel=1e-5) and fits[1].intercept == pytest.approx(model.intercept, rel=1e-5)


def test_logistic_of_folds_that_have_no_optimum(spark):
    rows = [("apart", float(x), float(x > 0)) for x in (-3, -2, -1, 1, 2, 3)] + [("one", float(x), 1.0) for x in range(5)] + [("flat", 2.0, float(x % 4 == 0)) for x in range(40)]
    fits = {r.k: r for r in logistic.fit(spark.createDataFrame(rows, "k string, x double, y double"), ["x"], ["k"]).collect()}
    assert not fits["apart"].converged and fits["apart"].coefs[0] > 3 and np.isfinite(fits["apart"].coefs[0])
    assert fits["one"].coefs == [0.0] and fits["one"].intercept == pytest.approx(np.log(5.5 / 0.5))
    assert fits["flat"].converged and fits["flat"].coefs == [0.0] and fits["flat"].intercept == pytest.approx(np.log(10 / 30))
    assert logistic.fit(spark.createDataFrame([], "k string, x double, y double"), ["x"], ["k"]).count() == 0


def _max_min(pred, y):
    """Isotonic regression by its formula, at each different prediction."""
    p = np.unique(pred)
    n, s = np.array([(pred == v).sum() for v in p]), np.array([y[pred == v].sum() for v in p])
    return p, np.array([max(min(s[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(p))) for a in range(i + 1)) for i in range(len(p))])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 1)), min_size=1, max_size=40), st.integers(1, 6))
def test_pooling_is_associative(pairs, parts):
    pred, y = np.array([p for p, _ in pairs], float), np.array([v for _, v in pairs], float)
    p, want = _max_min(pred, y)
    points = pd.DataFrame({"lo": p, "hi": p, "n": [(pred == v).sum() for v in p], "s": [y[pred == v].sum() for v in p]}, dtype=float)
    made = calibration.pooled(pd.concat([calibration.pooled(points.iloc[i]) for i in np.array_split(np.arange(len(p)), parts) if len(i)]))
    got = [(made.s / made.n)[(made.lo <= v) & (v <= made.hi)].iloc[0] for v in p]
    assert got == pytest.approx(want.tolist()) and (made.hi.to_numpy()[:-1] < made.lo.to_numpy()[1:]).all()


@pytest.mark.parametrize("limit", [10, 100_000])
def test_isotonic_by_fold(spark, monkeypatch, limit):
    monkeypatch.setattr(order, "LIMIT", limit)
    rng = np.random.default_rng(6)
    data = pd.DataFrame({"f": rng.integers(0, 3, 300), "pred": rng.integers(0, 60, 300) / 60})
    data["y"] = (rng.random(300) < data.pred).astype(float)
    rows = spark.createDataFrame(data).withColumn("at", F.monotonically_increasing_id())
    asked = rows.withColumn("pred", F.col("pred") + 0.004).unionByName(rows).unionByName(rows.limit(1).withColumn("f", F.lit(9).cast("long")))
    out = calibration.isotonic(rows, asked, ["f"]).toPandas()
    assert len(out) == 601 and out[out.f == 9].proba.isna().all() and list(out.columns) == ["f", "pred", "y", "at", "proba"]
    for f, d in data.groupby("f"):
        p, g = _max_min(d.pred.to_numpy(), d.y.to_numpy())
        own = out[out.f == f]
        assert own.proba.to_numpy() == pytest.approx(np.interp(own.pred, p, g), abs=1e-12)


def test_platt_by_fold_keeps_every_fold(spark):
    rng = np.random.default_rng(2)
    pred = rng.normal(size=200)
    data = pd.DataFrame({"f": np.arange(200) % 2, "pred": pred, "y": (rng.random(200) < 1 / (1 + np.exp(-2 * pred))).astype(float)})
    rows = spark.createDataFrame(data)
    out = calibration.platt(rows, rows.unionByName(rows.limit(3).withColumn("f", F.lit(5).cast("long"))), ["f"]).toPandas()
    assert len(out) == 203 and out[out.f == 5].proba.isna().all()
    for _, d in out[out.f < 5].groupby("f"):
        assert d.proba.mean() == pytest.approx(d.y.mean(), abs=1e-6)  # a logistic fit's mean is the labels'


def _slow_trees(x, y, rounds, depth, bins, step, classes, least=1):
    """Boosting row by row: every threshold of every node is tried on the rows themselves."""
    edges = [list(dict.fromkeys(np.quantile(x[:, f], np.arange(1, bins) / bins))) for f in range(x.shape[1])]
    score = np.full(len(y), np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)) if classes else y.mean())

    def grow(rows, level, g, h, out):
        best = (1e-12, None)
        for f, cuts in enumerate(edges):
            for e in cuts:
                a = x[rows, f] <= e
                if min(a.sum(), (~a).sum()) < least:
                    continue
                gl, hl, gr, hr = g[rows][a].sum(), h[rows][a].sum(), g[rows][~a].sum(), h[rows][~a].sum()
                gain = gl**2 / hl + gr**2 / hr - (gl + gr) ** 2 / (hl + hr)
                if gain > best[0] * (1 + 1e-9):
                    best = (gain, rows[a], rows[~a], gl / hl, gr / hr)
        if best[1] is None:
            return
        out[best[1]], out[best[2]] = best[3], best[4]
        if level > 1:
            grow(best[1], level - 1, g, h, out)
            grow(best[2], level - 1, g, h, out)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = (y - p, p * (1 - p)) if classes else (y - score, np.ones(len(y)))
        out = np.zeros(len(y))
        grow(np.arange(len(y)), depth, g, h, out)
        score = score + step * out
    return 1 / (1 + np.exp(-score)) if classes else score


@pytest.mark.parametrize("classes", [False, True])
def test_boosted_trees_of_several_folds(spark, classes):
    frames, want = [], {}
    params = {"maxIter": 4, "maxDepth": 3, "maxBins": 8, "stepSize": 0.5, "minInstancesPerNode": 3}
    for k, n in ((1, 160), (2, 70), (3, 9)):
        rng = np.random.default_rng(k)
        x = np.c_[rng.normal(size=n), rng.integers(0, 4, n), rng.normal(size=n)]
        y = np.sin(2 * x[:, 0]) + (x[:, 1] > 1) * x[:, 2] + rng.normal(0, 0.1, n)
        y = (y > 0.2).astype(float) if classes else y
        frames.append(pd.DataFrame({"k": k, "i": np.arange(n), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y}))
        want[k] = _slow_trees(x, y, 4, 3, 8, 0.5, classes, 3)
    rows = spark.createDataFrame(pd.concat(frames))
    fits = boosting.fit(rows, ["a", "b", "c"], ["k"], params, classes)
    made = boosting.probability if classes else boosting.score
    out = rows.join(fits, "k").withColumn("pred", made(["a", "b", "c"])).toPandas()
    for k, own in out.groupby("k"):
        assert own.sort_values("i").pred.to_numpy() == pytest.approx(want[k], abs=1e-9), k
    told = {r.k: r for r in fits.collect()}
    assert all(sum(r.coefs) in (0.0, pytest.approx(1)) and len(r.trees) == 4 for r in told.values())
