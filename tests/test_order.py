import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from foldspark.operators import diagnostics, order


def _values(kind):
    rng = np.random.default_rng(len(kind))
    return {
        "normal": rng.normal(size=2500),
        "ties": rng.integers(-3, 4, 2500) / 2.0,
        "one": np.full(700, 1e-9),
        "tails": np.concatenate((rng.standard_cauchy(900) ** 5, [-1e300, 1e300, 1.7e308, -1.7e308, 5e-324, -5e-324, 0.0, -0.0])),
        "hot": np.concatenate((np.full(2000, 0.25), rng.normal(0.25, 1e-12, 400), rng.normal(size=100))),
        "single": np.array([3.0]),
    }[kind]


KINDS = ["normal", "ties", "one", "tails", "hot", "single"]


@pytest.fixture(scope="module")
def data(spark):
    made = [(k, float(v)) for k in KINDS for v in _values(k)] + [(None, 1.0), (None, 2.0), ("normal", None), ("normal", float("nan")), ("none", None)]
    return spark.createDataFrame(made, "g string, x double").repartition(5).cache()


@pytest.mark.parametrize("limit", [5, 60, 100_000])
def test_quantiles_are_exact(data, limit):
    at = [0.0, 0.01, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = {r.g: r.q for r in order.quantiles(data, ["g"], "x", at, "q", limit).collect()}
    want = {r.g: r.q for r in data.filter("not isnan(x)").groupBy("g").agg(F.percentile("x", F.array(*map(F.lit, at))).alias("q")).collect()}
    assert set(got) == {*KINDS, None}
    for g, q in got.items():
        assert q == pytest.approx(want[g], rel=1e-12), g


@pytest.mark.parametrize("limit", [5, 60, 100_000])
def test_ranks_are_exact(data, limit):
    got = order.average_ranks(data, ["g"], "x", "r", limit).toPandas()
    assert list(got.columns) == ["g", "x", "r"] and len(got) == sum(len(_values(k)) for k in KINDS) + 2
    got["want"] = got.groupby("g", dropna=False)["x"].rank(method="average")
    assert (got.r == got.want).all()


def test_no_bin_is_larger_than_the_limit(data):
    bins = order.Placed(data, ["g"], "x", 60).bins.toPandas()
    assert ((bins._n <= 60) | (bins._low == bins._high)).all()
    for _, own in bins.groupby("g", dropna=False):
        own = own.sort_values("_before")
        assert (own._high.to_numpy()[:-1] < own._low.to_numpy()[1:]).all() and own._n.sum() == own._total.iloc[0]


def test_empty(spark, data):
    none = data.filter("false")
    assert order.quantiles(none, ["g"], "x", [0.5]).count() == 0 and order.average_ranks(none, ["g"], "x", "r").count() == 0


def test_diagnostics_do_not_depend_on_the_limit(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 1200
    rows = pd.DataFrame({"outer_fold_id": rng.integers(0, 3, n), "asset": "a", "bar_ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h"), "y": rng.integers(0, 2, n).astype(float), "pred": rng.integers(1, 40, n) / 50, "split_role": np.where(rng.random(n) < 0.7, "train", "test"), "x": rng.normal(size=n), "z": rng.integers(0, 5, n) * 1.0})
    df = spark.createDataFrame(rows)
    made = (
        lambda: diagnostics.rank_ic(df, ["outer_fold_id"]), lambda: diagnostics.classification_metrics(df, ["outer_fold_id"]), lambda: diagnostics.psi(df, ["x", "z"]),
        lambda: diagnostics.drift_quantiles(df, ["x", "z"]), lambda: diagnostics.residual_profile(df, ["outer_fold_id"]),
    )
    whole = [sorted(map(tuple, f().collect())) for f in made]
    monkeypatch.setattr(order, "LIMIT", 10)
    for a, b in zip(whole, [sorted(map(tuple, f().collect())) for f in made]):
        for r, s in zip(a, b, strict=True):
            assert all(x == (y if isinstance(y, str) else pytest.approx(y, rel=1e-9)) for x, y in zip(r, s, strict=True))
    by = rows[rows.outer_fold_id == 0]
    assert whole[0][0][1] == pytest.approx(by.y.rank().corr(by.pred.rank()))
