import numpy as np
import pytest
from helpers import START, linear
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from foldspark import queries as q
from foldspark.operators import calibration, diagnostics, folds, leakage, models, projection, ridge, selection, transforms, tuning

SF = "/root/testdata/sf0.01"


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(5, 200), train=st.integers(1, 80), test=st.integers(1, 40), gap=st.integers(0, 30), rolling=st.booleans())
def test_fold_plans(spark, n, train, test, gap, rolling):
    spec = folds.ValidationSpec("rolling" if rolling else "expanding", train, test, gap, 30 if rolling else None)
    panel = spark.range(n).select(F.col("id").cast("int").alias("t_idx"))
    plan = sorted(folds.outer_folds(panel, spec).collect(), key=lambda r: r["outer_fold_id"])
    assert len(plan) == max(0, -(-(n - train - gap) // test))
    for i, r in enumerate(plan):
        assert r["outer_fold_id"] == i and r["train_end"] + gap == r["test_start"] < r["test_end"] <= n
        assert r["train_end"] - r["train_start"] == (min(30, r["train_end"]) if rolling else r["train_end"])
    assert all(a["test_end"] == b["test_start"] for a, b in zip(plan, plan[1:]))
    inner = folds.inner_folds(folds.outer_folds(panel, spec), folds.ValidationSpec(min_train_size=3, test_size=4, embargo=gap)).collect()
    outer = {r["outer_fold_id"]: r for r in plan}
    for r in inner:
        o = outer[r["outer_fold_id"]]
        assert o["train_start"] <= r["train_start"] < r["train_end"] <= r["test_start"] < r["test_end"] <= o["train_end"]


def test_bad_specs():
    for bad in ({"split_type": "x"}, {"split_type": "rolling"}, {"min_train_size": 0}, {"embargo": -1}, {"mode": "x"}):
        with pytest.raises(ValueError):
            folds.ValidationSpec(**bad)


def test_purge(spark):
    rows = q.model_rows(spark, SF).filter("label_end_idx is not null")
    out = folds.assign(rows, folds.outer_folds(rows, q.SPEC), 0)
    leakage.check_purged(out)
    with pytest.raises(leakage.LeakageError):
        leakage.check_purged(out.withColumn("split_role", F.when(F.col("t_idx") < F.col("test_start"), "train").otherwise("test")))


def test_ridge_is_numpys_and_mllibs(spark):
    rows = q.model_rows(spark, SF)
    plan = folds.outer_folds(rows, q.SPEC)
    names = ["ret5", "vol20", "range1"]
    got = {r["outer_fold_id"]: r for r in ridge.fit(rows, plan, names, alphas=[2.0], gap=q.GAP).collect()}
    data = rows.toPandas()
    for fold in plan.collect():
        d = data.dropna(subset=[*names, "y", "label_end_idx"])
        d = d[(d.t_idx + q.GAP < fold["test_start"]) & (d.label_end_idx < fold["test_start"])]
        x, y = d[names].to_numpy(), d.y.to_numpy()
        xc, yc = x - x.mean(0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc)
        assert got[fold["outer_fold_id"]]["n_train"] == len(d)
        assert np.allclose(got[fold["outer_fold_id"]]["coefs"], beta, rtol=1e-6)
        if fold["outer_fold_id"] == 0:
            train = spark.createDataFrame(d[[*names, "y"]]).withColumnRenamed("y", "label")
            vec = VectorAssembler(inputCols=names, outputCol="features").transform(train)
            reg = 2.0 * float(y.std()) / len(y)
            fit = LinearRegression(regParam=reg, elasticNetParam=0.0, standardization=False, solver="normal").fit(vec)
            assert np.allclose(fit.coefficients.toArray(), beta, rtol=1e-4)


def test_exact_line_without_penalty(spark):
    rows = spark.createDataFrame([(i, i + 1, float(i), 2.0 * i + 1) for i in range(20)], "t_idx int, label_end_idx int, x double, y double")
    plan = spark.createDataFrame([(0, 0, 15, 16, 20)], "outer_fold_id int, train_start int, train_end int, test_start int, test_end int")
    fit = ridge.fit(rows, plan, ["x"], alphas=[0.0], gap=0).first()
    assert fit["coefs"][0] == pytest.approx(2) and fit["intercept"] == pytest.approx(1)


def test_inner_losses_are_those_of_rows(spark):
    rows = q.model_rows(spark, SF)
    plan = folds.outer_folds(rows, q.SPEC)
    scores = {(r["outer_fold_id"], r["inner_fold_id"]): r["mse"] for r in tuning.inner_scores(rows, plan, q.INNER, q.A, [1.0]).collect()}
    preds = tuning.out_of_fold(rows, plan, q.INNER, q.A).filter("pred is not null and y is not null")
    for r in preds.groupBy("outer_fold_id", "inner_fold_id").agg(F.avg(diagnostics.squared_error()).alias("mse")).collect():
        assert scores[r[0], r[1]] == pytest.approx(r["mse"], rel=1e-6)


def test_out_of_fold_covers_each_row_once(spark):
    rows = q.model_rows(spark, SF)
    plan = folds.outer_folds(rows, q.SPEC)
    preds = tuning.out_of_fold(rows, plan, q.INNER, q.A).filter("pred is not null")
    inner = folds.inner_folds(plan, q.INNER)
    expected = rows.dropna(subset=q.A).join(inner, (F.col("t_idx") >= F.col("test_start")) & (F.col("t_idx") < F.col("test_end")))
    leakage.check_coverage(expected, preds, ["outer_fold_id", "asset", "bar_ts"])
    assert preds.join(plan, "outer_fold_id").filter("t_idx >= train_end").count() == 0


def _roles(spark):
    rows = [("a", t, "train" if t < 30 else "test", float(t % 5) + (3.0 if t >= 30 else 0.0), 4.0) for t in range(60)]
    return spark.createDataFrame(rows, "asset string, t_idx int, split_role string, x double, c double").withColumn("outer_fold_id", F.lit(0)).withColumn("bar_ts", F.lit(START).cast("timestamp_ntz"))


def test_drift_of_a_step(spark):
    rows = _roles(spark)
    moved = diagnostics.drift_moments(rows, ["x"]).first()
    assert moved["mean_shift"] > 1 and moved["std_ratio"] == pytest.approx(1)
    assert diagnostics.psi(rows, ["x"]).first()["psi"] > 0.5
    assert diagnostics.psi(rows.withColumn("x", F.col("x") - F.when(F.col("split_role") == "test", 3.0).otherwise(0.0)), ["x"]).first()["psi"] == pytest.approx(0, abs=1e-9)
    assert diagnostics.drift_correlation(rows, ["x", "c"]).first()["corr_change"] is None
    assert diagnostics.drift_moments(rows, ["c"]).first()["mean_shift"] is None


def test_transforms_see_only_training_rows(spark):
    rows = _roles(spark)
    other = rows.withColumn("x", F.when(F.col("split_role") == "test", F.col("x") * 100).otherwise(F.col("x")))
    for make in (transforms.standardise, transforms.winsorise):
        a, b = (make(r, ["x"]).filter("split_role = 'train'").select("t_idx", "x").collect() for r in (rows, other))
        assert sorted(a) == sorted(b)


def test_projection_waits_until_known(spark):
    rows = spark.createDataFrame([("a", t) for t in range(10)], "asset string, t_idx int")
    diag = spark.createDataFrame([(0, 3, 1.0), (1, 6, 2.0)], "outer_fold_id int, known_at int, v double")
    got = {r["t_idx"]: (r["v"], r["has_health"]) for r in projection.project_asof(rows, diag, ["v"]).collect()}
    assert [got[t][0] for t in range(10)] == [None] * 4 + [1.0] * 3 + [2.0] * 3 and got[3][1] == 0
    late = {r["t_idx"]: r["v"] for r in projection.project_asof(rows, diag, ["v"], lag_folds=1).collect()}
    assert late[6] is None and late[7] == 1.0


def test_selection_uses_only_known_scores(spark):
    scores = spark.createDataFrame(
        [("a", 0, 1.0, 10, 5), ("b", 0, 2.0, 10, 5), ("a", 1, 9.0, 30, 20), ("b", 1, 1.0, 30, 20), ("a", 2, 5.0, 60, 40), ("b", 2, 5.0, 60, 40)],
        "candidate string, outer_fold_id int, score double, known_at int, test_start int",
    )
    best = {r["outer_fold_id"]: r["candidate"] for r in selection.best_recent(scores, 1).filter("chosen").collect()}
    assert best == {1: "a", 2: "b"}
    weights = selection.blend_weights(scores, 2).groupBy("outer_fold_id").agg(F.sum("weight")).collect()
    assert all(r[1] == pytest.approx(1) for r in weights)


def test_auc_and_rank_ic(spark):
    rows = spark.createDataFrame([(0, "a", 0.0, 0.1), (0, "a", 0.0, 0.4), (0, "a", 1.0, 0.35), (0, "a", 1.0, 0.8)], "outer_fold_id int, asset string, y double, pred double")
    assert diagnostics.classification_metrics(rows, ["outer_fold_id"]).first()["auc"] == pytest.approx(0.75)
    assert diagnostics.rank_ic(rows.withColumn("y", F.col("pred") * F.col("pred")), ["outer_fold_id"]).first()["rank_ic"] == pytest.approx(1)


def test_registry_of_models():
    with pytest.raises(ValueError):
        models.algorithm("lasso", "classification")
    with pytest.raises(KeyError):
        models.algorithm("none", "regression")
    spec = models.HyperoptSpec(space={"alpha": [1, 2], "k": [3, 4]})
    assert len(spec.candidates()) == 4
    draws = models.HyperoptSpec("random", space={"alpha": ("log", -2, 2)}, samples=5, seed=3)
    assert draws.candidates() == draws.candidates() and all(0.01 <= c["alpha"] <= 100 for c in draws.candidates())


def test_calibration_is_monotone(spark):
    rows = spark.createDataFrame([(i / 50, float((i * 7) % 50 < i)) for i in range(50)], "pred double, y double")
    for make in (calibration.isotonic, calibration.platt):
        out = [r["proba"] for r in make(rows, rows).orderBy("pred").collect()]
        assert all(0 <= a <= b + 1e-9 <= 1 + 2e-9 for a, b in zip(out, out[1:]))


def test_pca_loadings(spark):
    rows = q._roles(spark, SF, q.WIDE)
    loadings = transforms.components(rows, q.WIDE, 2)
    total = loadings.groupBy("outer_fold_id", "component").agg(F.sum(F.col("loading") * F.col("loading")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in total)
    assert transforms.project(rows, loadings, q.WIDE, 2).filter("pc0 is null and split_role = 'test'").count() == 0


def test_linear_has_no_leak(spark):
    assert linear(spark).filter("t_idx = 0").count() == 2


def test_large_plans_meet_rows_by_buckets(spark, monkeypatch):
    """The same rows as by broadcast, without a product of rows and folds."""
    rows = q.model_rows(spark, SF)
    plan = folds.inner_folds(folds.outer_folds(rows, q.SPEC), q.INNER)
    keys = ["outer_fold_id", "inner_fold_id", "asset", "bar_ts", "split_role"]
    told = lambda df: sorted(map(str, df.collect()))
    small = [told(folds.assign(rows, plan, q.GAP).select(*keys)), told(ridge.long_coefs(ridge.fit(rows, plan, q.A), q.A).select("outer_fold_id", "inner_fold_id", "feature", F.round("coef", 8)))]
    preds = told(tuning.out_of_fold(rows, folds.outer_folds(rows, q.SPEC), q.INNER, q.A).select(*keys[:4], F.round("pred", 8)))
    monkeypatch.setattr(folds, "BROADCAST_FOLDS", 0)
    for bucket in (1, 64):
        monkeypatch.setattr(folds, "BUCKET", bucket)
        met = folds.assign(rows, plan, q.GAP)
        text = met._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in text and "Cartesian" not in text
        assert [told(met.select(*keys)), told(ridge.long_coefs(ridge.fit(rows, plan, q.A), q.A).select("outer_fold_id", "inner_fold_id", "feature", F.round("coef", 8)))] == small
    assert told(tuning.out_of_fold(rows, folds.outer_folds(rows, q.SPEC), q.INNER, q.A).select(*keys[:4], F.round("pred", 8))) == preds


def test_ridge_of_inputs_far_from_zero(spark):
    """Squares of values near 1e9 keep no digit of a spread of 1."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2)) + [1e9, -3e9]
    y = x @ [0.5, -2.0] - (0.5e9 + 6e9) + 1.0
    rows = spark.createDataFrame([(t, t, *map(float, r), float(v)) for t, (r, v) in enumerate(zip(x, y))], "t_idx int, label_end_idx int, a double, b double, y double")
    plan = spark.createDataFrame([(0, 0, 150, 160, 200)], "outer_fold_id int, train_start int, train_end int, test_start int, test_end int")
    fit = ridge.fit(rows, plan, ["a", "b"], alphas=[0.0], gap=0)
    assert fit.first()["coefs"] == pytest.approx([0.5, -2.0], rel=1e-5)
    out = ridge.predict(rows, plan, fit, ["a", "b"])
    assert out.filter("abs(pred - y) > 1e-4").isEmpty() and out.count() == 40
    made = ridge.cells(rows, ["a", "b"], "y", 0)
    loss = ridge.losses(ridge.fold_sums(made, plan, "test"), fit, ["a", "b"], ["outer_fold_id"]).first()
    assert loss["n_test"] == 40 and loss["mse"] < 1e-4
    raw = ridge.fit(rows.withColumns({"a": F.col("a") - 1e9 + 3, "b": F.col("b") + 3e9}), plan, ["a", "b"], alphas=[1.0], gap=0, intercept=False).first()["coefs"]
    z = (x - [1e9 - 3, -3e9])[:160]
    assert raw == pytest.approx(np.linalg.solve(z.T @ z + np.eye(2), z.T @ y[:160]).tolist(), rel=1e-6)
