"""A query for each operator of the engine, over whole tables.

The panel is hourly event bars with the time index.  Folds, horizons and penalties are
those of ``SPEC`` and the constants below; ``foldspark.oracles`` has the same in SQL.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions import features as feat
from foldspark.functions import targets as tgt
from foldspark.operators import analysis, calibration, derived, diagnostics, folds, models, projection, ridge, selection, transforms, tuning
from foldspark.operators.folds import ValidationSpec
from foldspark.operators.lineage import cut, scratch
from foldspark.plans.graph import WorkflowGraph
from foldspark.plans.inspect import Run, load_run
from foldspark.plans.nodes import DiagnosticNode, TransformNode
from foldspark.plans.recipes import DiagnosticAwareMetaRecipe, NestedTuningRecipe, SelectorRecipe, SingleModelRecipe, StackedModelRecipe
from foldspark.plans.runner import Runner
from foldspark.plans.specs import DiagnosticInputs
from foldspark.sources import bars as src
from foldspark.sources.vendors import TableVendor

H, GAP, ALPHA = 20, 20, 1.0
SPEC = ValidationSpec(min_train_size=300, test_size=100, embargo=GAP)
ROLLING = ValidationSpec(split_type="rolling", min_train_size=300, test_size=100, embargo=GAP, rolling_train_size=250)
INNER = ValidationSpec(min_train_size=120, test_size=50, embargo=GAP)
PER_ASSET = ValidationSpec(min_train_size=300, test_size=100, embargo=GAP, mode="per_asset")
A, B = ["ret5", "vol20"], ["ret1", "mom20"]
DRIFT = ["ret5", "vol20", "range1"]
WIDE = ["ret1", "ret5", "ret20", "vol20", "mom20", "range1"]
ALPHAS = [0.01, 1.0, 100.0]


def rounded(df: DataFrame, digits: int = 6, whole: Sequence[str] = ()) -> DataFrame:
    """Doubles rounded, as engines add up in different orders; ``whole`` are integers with NULLs, given as doubles."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c).cast("double").alias(c) if c in whole else F.col(c) for c, t in df.dtypes))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.with_time_index(src.event_bars(spark, sf_dir))


def _features(p: DataFrame) -> list:
    return feat.Baseline().build(feat.Baseline.defaults)


def model_rows(spark: SparkSession, sf_dir: str, target: Callable[[int], Column] = tgt.forward_return, h: int = H, more: dict[str, Column] | None = None) -> DataFrame:
    """Bars with features, target and the time at which the label is known (and ``more``): all from one sort by asset.

    Plans, fits and predictions all start from it, so it is computed once.
    """
    p = feat.with_returns(panel(spark, sf_dir))
    made = p.select(
        "asset", "bar_ts", "t_idx", *(f.value.alias(f.name) for f in _features(p)), target(h).cast("double").alias("y"), F.lead("t_idx", h).over(feat.by_asset()).alias("label_end_idx"),
        *(v.alias(n) for n, v in (more or {}).items()),
    )
    return cut(made)


def _outer(rows: DataFrame) -> DataFrame:
    return folds.outer_folds(rows, SPEC)


def scored(spark: SparkSession, sf_dir: str, features: Sequence[str] = A, target: Callable[[int], Column] = tgt.forward_return, h: int = H) -> DataFrame:
    """Test predictions that can be judged: complete inputs and a known label."""
    return _scored(model_rows(spark, sf_dir, target, h), features)


def _scored(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    plan = _outer(rows)
    out = ridge.predict(rows, plan, ridge.fit(rows, plan, features, alphas=[ALPHA], gap=GAP), features)
    return out.filter("pred is not null and y is not null")


def both_roles(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Training and test rows of each fold with its model's predictions."""
    rows = ridge.complete(model_rows(spark, sf_dir) if rows is None else rows, [*A, "y"])
    plan = _outer(rows)
    fits = ridge.fit(rows, plan, A, alphas=[ALPHA], gap=GAP)
    out = folds.assign(rows, plan, GAP).filter("split_role <> 'embargo'").join(fits, "outer_fold_id")
    return out.withColumn("pred", F.col("intercept") + F.col("coefs")[0] * F.col(A[0]) + F.col("coefs")[1] * F.col(A[1]))


def candidates(spark: SparkSession, sf_dir: str, rows: DataFrame | None = None) -> DataFrame:
    """Test predictions of two models on different inputs."""
    rows = model_rows(spark, sf_dir) if rows is None else rows
    return _scored(rows, A).withColumn("candidate", F.lit("a")).unionByName(_scored(rows, B).withColumn("candidate", F.lit("b")))


def fold_scores(spark: SparkSession, sf_dir: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of each candidate and fold, when it was known, and the fold's test start."""
    base = model_rows(spark, sf_dir)
    rows = candidates(spark, sf_dir, base)
    if by:
        rows = rows.withColumn("regime", (F.col("vol20") > 1.0).cast("int"))
    e = F.col("y") - F.col("pred")
    start = _outer(base).select("outer_fold_id", "test_start")
    return rows.groupBy(*by, "candidate", "outer_fold_id").agg(F.avg(e * e).alias("score"), diagnostics.known_at()).join(start, "outer_fold_id")


# -- data ------------------------------------------------------------------------------


def bars_event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.event_bars(spark, sf_dir), 4)


def bars_order_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.order_bars(spark, sf_dir), 2)


def bars_part_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.part_bars(spark, sf_dir).groupBy("asset").agg(F.count(F.lit(1)).alias("n_bars"), F.sum("n_trades").alias("n_trades"), F.min("bar_ts").alias("first_ts"), F.max("bar_ts").alias("last_ts"), *(F.round(F.sum(c), 2).alias(c) for c in ("open", "high", "low", "close", "volume")))


def schema_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("sym"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("at"), F.col("value").cast("string").alias("px"), F.col("event_id").alias("size")
    )
    return rounded(src.normalise(raw, {"asset": "sym", "bar_ts": "at", "close": "px", "volume": "size"}).select("asset", "bar_ts", "close", "volume"), 4)


def universe_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("event_type").alias("asset")).count()
    universe = types.orderBy("asset").limit(2).select(F.lit("first").alias("universe_name"), "asset")
    return src.in_universe(src.event_bars(spark, sf_dir), universe, "first").groupBy("asset").agg(F.count(F.lit(1)).alias("n"), F.sum("n_trades").alias("trades"))


def time_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).select("asset", "bar_ts", "t_idx")


# -- features and targets ----------------------------------------------------------------


def feat_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.Baseline().apply(src.event_bars(spark, sf_dir), {}))


def feat_cross_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.CrossAsset().apply(src.event_bars(spark, sf_dir), {}), 5)


def feat_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.Regime().apply(src.event_bars(spark, sf_dir), {}), whole=["high_vol", "trend"])


def feat_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(feat.default_registry().compose(src.event_bars(spark, sf_dir), [("baseline", {}), ("regime", {})]).select("asset", "bar_ts", "ret5", "vol20", "high_vol", "trend"), whole=["high_vol", "trend"])


def feat_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A family from an outside package, here a function of two columns, through the adapter."""
    return rounded(feat.FieldAdapter(field_features).apply(src.event_bars(spark, sf_dir), {"scale": 100.0}))


def field_features(bars: DataFrame, params: dict) -> DataFrame:
    gap = F.col("open") / F.nullif(F.lag("close").over(feat.by_asset()), F.lit(0.0)) - 1
    return bars.select("asset", "bar_ts", (gap * params["scale"]).alias("gap1"), (F.col("close") / F.nullif("open", F.lit(0.0)) - 1).alias("body1"))


def last_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last close of a bar with several trades, carried forward over the others."""
    several = F.when(F.col("n_trades") > 1, F.col("close"))
    return rounded(src.event_bars(spark, sf_dir).select("asset", "bar_ts", feat.last_known(several).alias("known_close")))


def regression_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the target on one input, by Spark's regression aggregates."""
    rows = model_rows(spark, sf_dir).filter("ret5 is not null and y is not null")
    made = {"slope": F.regr_slope, "intercept": F.regr_intercept, "r2": F.regr_r2}
    return rounded(rows.groupBy("asset").agg(F.regr_count("y", "ret5").alias("n"), *(f("y", "ret5").alias(n) for n, f in made.items())))


def _target(build: Callable[[int], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(tgt.PredictionTask("t", "regression", H, build).table(panel(spark, sf_dir)).select("asset", "bar_ts", "y", "label_end_idx"), whole=["label_end_idx"])

    return query


# -- validation ---------------------------------------------------------------------------


def folds_expanding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outer(panel(spark, sf_dir))


def folds_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.outer_folds(panel(spark, sf_dir), ROLLING)


def folds_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.inner_folds(_outer(panel(spark, sf_dir)), INNER)


def folds_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.outer_folds(panel(spark, sf_dir), PER_ASSET)


def split_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir).filter("label_end_idx is not null")
    return folds.assign(rows, _outer(panel(spark, sf_dir)), GAP).groupBy("outer_fold_id", "split_role").agg(F.count(F.lit(1)).alias("n"), F.max("label_end_idx").alias("last_label"))


# -- models ---------------------------------------------------------------------------------


def fit_ridge_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    return rounded(ridge.long_coefs(ridge.fit(rows, _outer(rows), A, alphas=[ALPHA], gap=GAP), A), 5)


def fit_ridge_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    return rounded(ridge.long_coefs(ridge.fit(rows, folds.outer_folds(rows, ROLLING), A, alphas=[ALPHA], gap=GAP), A), 5)


def fit_ridge_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset on its own time index, with a model of its own."""
    rows = _own_index(spark, sf_dir)
    return rounded(ridge.long_coefs(ridge.fit(rows, folds.outer_folds(rows, PER_ASSET), A, alphas=[ALPHA], gap=GAP), A), 5)


def _own_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir).withColumn("t_idx", (F.row_number().over(feat.by_asset()) - 1).cast("int"))
    return rows.withColumn("label_end_idx", F.lead("t_idx", H).over(feat.by_asset()))


def predict_ridge_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _own_index(spark, sf_dir)
    plan = folds.outer_folds(rows, PER_ASSET)
    out = ridge.predict(rows, plan, ridge.fit(rows, plan, A, alphas=[ALPHA], gap=GAP), A).filter("pred is not null and y is not null")
    return rounded(out.select("asset", "bar_ts", "outer_fold_id", "y", "pred"), 5)


def predict_ridge_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scored(spark, sf_dir).select("asset", "bar_ts", "outer_fold_id", "y", "pred"), 5)


def _roles(spark: SparkSession, sf_dir: str, columns: Sequence[str]) -> DataFrame:
    rows = ridge.complete(model_rows(spark, sf_dir), [*columns, "y"])
    return folds.assign(rows, _outer(rows), GAP)


def scale_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.standardise(_roles(spark, sf_dir, DRIFT), DRIFT).filter("split_role = 'test'")
    return rounded(out.select("asset", "bar_ts", "outer_fold_id", *DRIFT), 5)


def clip_train_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = transforms.winsorise(_roles(spark, sf_dir, DRIFT), DRIFT).filter("split_role = 'test'")
    return rounded(out.select("asset", "bar_ts", "outer_fold_id", *DRIFT))


def select_topk_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(transforms.top_correlated(_roles(spark, sf_dir, WIDE), WIDE, 3))


def grid_inner_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    return rounded(tuning.inner_scores(rows, _outer(rows), INNER, A, ALPHAS, gap=GAP), 4)


def grid_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    return rounded(tuning.best(tuning.inner_scores(rows, _outer(rows), INNER, A, ALPHAS, gap=GAP)), 4)


TWO = models.HyperoptSpec(space={"alpha": ALPHAS, "fit_intercept": [True, False]})


def grid_two_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every combination of penalty and intercept on every inner fold."""
    rows = model_rows(spark, sf_dir)
    return rounded(tuning.grid(rows, _outer(rows), INNER, A, TWO.candidates(), gap=GAP), 4)


def grid_by_mae(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's best penalty by mean absolute error."""
    rows = model_rows(spark, sf_dir)
    return rounded(tuning.best_candidates(tuning.grid(rows, _outer(rows), INNER, A, [{"alpha": a} for a in ALPHAS], "mae", GAP)), 4)


def oof_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    out = tuning.out_of_fold(rows, _outer(rows), INNER, A, ALPHA, GAP).filter("pred is not null")
    return rounded(out.select("outer_fold_id", "inner_fold_id", "asset", "bar_ts", "pred"), 5)


def _meta(spark: SparkSession, sf_dir: str, target: Callable[[int], Column], h: int, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """(coefficients, predictions) of a meta model on base predictions of two other targets.

    In each outer fold it trains on out-of-fold predictions and tests on those of
    the base models refitted on the whole training span.
    """
    base, plan = None, _outer(panel(spark, sf_dir))
    every = model_rows(spark, sf_dir, tgt.forward_return, H, {"y_vol": tgt.forward_volatility(H), "y_meta": target(h), "end_meta": F.lead("t_idx", h).over(feat.by_asset())})
    for name, y in (("p_ret", "y"), ("p_vol", "y_vol")):
        rows = every.withColumn("y", F.col(y))
        oof = tuning.out_of_fold(rows, plan, INNER, A, ALPHA, GAP).select("outer_fold_id", "asset", "bar_ts", "pred", F.lit("oof").alias("role"))
        test = ridge.predict(rows, plan, ridge.fit(rows, plan, A, alphas=[ALPHA], gap=GAP), A).select("outer_fold_id", "asset", "bar_ts", "pred", F.lit("test").alias("role"))
        own = oof.unionByName(test).withColumnRenamed("pred", name)
        base = own if base is None else base.join(own, ["outer_fold_id", "asset", "bar_ts", "role"])
    meta = every.withColumns({"y": F.col("y_meta"), "label_end_idx": F.col("end_meta")}).join(base, ["asset", "bar_ts"])
    health = cut(diagnostics.deviance_gap(both_roles(spark, sf_dir, every)).withColumnRenamed("value", "gap_health"))
    meta = projection.project_asof(meta, health, ["gap_health"]).withColumn("gap_health", F.coalesce("gap_health", F.lit(0.0)))
    # Base predictions differ by fold, so sums are kept by fold and not shared.
    rows = meta.filter("role = 'oof'")
    made = ridge.cells(rows.withColumnRenamed("outer_fold_id", "fold"), features, "y", GAP, ["fold"])
    sums = _own_fold(made, plan)
    fits = ridge.solve(sums, features, [ALPHA], ["outer_fold_id"])
    pred = F.col("intercept")
    for i, f in enumerate(features):
        pred = pred + F.col("coefs")[i] * F.col(f)
    out = meta.filter("role = 'test'").join(fits, "outer_fold_id").withColumn("pred", pred).filter("pred is not null and y is not null")
    return fits, out


def _own_fold(cells: DataFrame, plan: DataFrame) -> DataFrame:
    """Sums of the cells that a fold may train on, of cells that belong to that fold."""
    both = cells.join(plan, F.col("fold") == F.col("outer_fold_id")).filter((F.col("t_idx") >= F.col("train_start")) & (F.col("e") < F.col("test_start")))
    sums = [c for c in cells.columns if c not in ("fold", "t_idx", "e")]
    return both.groupBy("outer_fold_id").agg(*(F.sum(c).alias(c) for c in sums))


def meta_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward return 40 from predictions of return 20 and volatility 20."""
    _, out = _meta(spark, sf_dir, tgt.forward_return, 40, ["p_ret", "p_vol"])
    return rounded(out.select("outer_fold_id", "asset", "bar_ts", "y", "pred"), 4)


def meta_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Max upside 40 from baseline features, both predictions and lagged fold health."""
    _, out = _meta(spark, sf_dir, tgt.max_upside, 40, ["ret5", "vol20", "p_ret", "p_vol", "gap_health", "has_health"])
    return rounded(out.select("outer_fold_id", "asset", "bar_ts", "y", "pred", "gap_health", "has_health"), 4)


def pca_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transforms.components(_roles(spark, sf_dir, WIDE), WIDE, 2)


def logit_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir, tgt.up_down)
    preds, _ = models.fit_predict(rows, _outer(rows), "logistic", A, "classification", gap=GAP)
    return rounded(diagnostics.classification_metrics(preds, ["outer_fold_id"]), 4)


def gbt_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    preds, _ = models.fit_predict(rows, _outer(rows), "gbt", A, "regression", {"maxIter": 3, "maxDepth": 2}, GAP)
    return diagnostics.regression_metrics(preds, ["outer_fold_id"])


def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(scored(spark, sf_dir, A, tgt.up_down))
    out = calibration.isotonic(rows.filter("outer_fold_id = 0"), rows.filter("outer_fold_id > 0"))
    return rounded(out.select("asset", "bar_ts", "outer_fold_id", "y", "pred", "proba"), 5)


def calibrated_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each fold's test predictions on the increasing curve of its own out-of-fold predictions; folds too early to have any have none."""
    rows = model_rows(spark, sf_dir, tgt.up_down)
    plan = _outer(rows)
    oof = tuning.out_of_fold(rows, plan, INNER, A, ALPHA, GAP)
    test = ridge.predict(rows, plan, ridge.fit(rows, plan, A, alphas=[ALPHA], gap=GAP), A)
    out = calibration.isotonic(oof, test, ["outer_fold_id"])
    return rounded(out.select("asset", "bar_ts", "outer_fold_id", "pred", "proba"), 5)


# -- diagnostics ------------------------------------------------------------------------------


def diag_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.deviance_gap(both_roles(spark, sf_dir)), 4)


def diag_drift_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.drift_moments(_roles(spark, sf_dir, DRIFT), DRIFT))


def diag_drift_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.drift_quantiles(_roles(spark, sf_dir, DRIFT), DRIFT))


def diag_psi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.psi(_roles(spark, sf_dir, DRIFT), DRIFT))


def diag_drift_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.drift_correlation(_roles(spark, sf_dir, DRIFT), DRIFT))


def diag_resid_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.residual_std(scored(spark, sf_dir)), 4)


def diag_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.disagreement(candidates(spark, sf_dir)), 5)


def diag_coef_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    return rounded(diagnostics.coefficient_stability(ridge.long_coefs(ridge.fit(rows, _outer(rows), A, alphas=[ALPHA], gap=GAP), A)), 5)


def diag_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, A, tgt.up_down).withColumn("pred", F.least(F.greatest(F.col("pred"), F.lit(0.0)), F.lit(1.0)))
    return rounded(diagnostics.calibration_gap(rows), 5)


def diag_calibration_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.regression_calibration_gap(scored(spark, sf_dir)), 5)


def diag_residual_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.residual_profile(scored(spark, sf_dir), ["outer_fold_id"]), 4)


def metrics_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.regression_metrics(scored(spark, sf_dir), ["outer_fold_id"]), 5)


def metrics_rank_ic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(diagnostics.rank_ic(scored(spark, sf_dir), ["outer_fold_id"]), 5)


def metrics_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(spark, sf_dir, A, tgt.up_down).withColumn("pred", F.least(F.greatest(F.col("pred"), F.lit(0.01)), F.lit(0.99)))
    return rounded(diagnostics.classification_metrics(rows, ["outer_fold_id"]), 4)


# -- derived features, projection, selection, analysis ------------------------------------------


def _one_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("asset", "bar_ts", "y", "pred")


def derived_resid_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derived.residual_std(_one_each(spark, sf_dir), H), 4)


def derived_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derived.model_health(_one_each(spark, sf_dir), H), 4)


def derived_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(derived.disagreement(candidates(spark, sf_dir)), 5)


def project_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = cut(diagnostics.deviance_gap(both_roles(spark, sf_dir)).withColumnRenamed("value", "gap_health"))
    rows = panel(spark, sf_dir).select("asset", "bar_ts", "t_idx")
    return rounded(projection.project_asof(rows, health, ["gap_health"]), 4)


def project_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    health = diagnostics.residual_std(scored(spark, sf_dir)).select("outer_fold_id", "asset", F.col("value").alias("resid_std"), "known_at")
    rows = panel(spark, sf_dir).select("asset", "bar_ts", "t_idx")
    return rounded(projection.project_asof(rows, health, ["resid_std"], by="asset"), 4)


def select_best_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.best_recent(fold_scores(spark, sf_dir)), 4)


def blend_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.blend_weights(fold_scores(spark, sf_dir)), 4)


def select_diag_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = fold_scores(spark, sf_dir)
    rows = model_rows(spark, sf_dir)
    bias = candidates(spark, sf_dir, rows).groupBy("candidate", "outer_fold_id").agg(F.abs(F.avg(F.col("y") - F.col("pred"))).alias("penalty"), diagnostics.known_at())
    penalties = bias.join(_outer(rows).select("outer_fold_id", "test_start"), "outer_fold_id")
    return rounded(selection.diagnostic_aware(scores, penalties, 1.0), 4)


def select_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.by_regime(fold_scores(spark, sf_dir, ["regime"])), 4)


def blend_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = selection.blend_weights(fold_scores(spark, sf_dir))
    return rounded(selection.apply_weights(candidates(spark, sf_dir), weights), 4)


def subgroup_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.subgroups(scored(spark, sf_dir)), 4, ["outer_fold_id"])


def residuals_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.residuals_by_time(scored(spark, sf_dir)), 4)


def compare_feature_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = model_rows(spark, sf_dir)
    return rounded(analysis.compare({"a": _scored(rows, A), "b": _scored(rows, B)}, "a"), 4)


def corr_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(analysis.asset_correlations(src.event_bars(spark, sf_dir)), 5)


# -- whole runs: compiled from a recipe, run node by node, read back by the inspection API ---------


def _run(spark: SparkSession, sf_dir: str, recipe) -> Run:
    runner = Runner(spark, scratch(spark), {"events": TableVendor(lambda s: src.event_bars(s, sf_dir))})
    return load_run(spark, runner.root, runner.run(recipe.compile()))


def _told(run: Run, name: str, digits: int) -> DataFrame:
    out = run.load_predictions(name, split_role="test").filter("pred is not null and y is not null")
    return rounded(out.select("asset", "bar_ts", "outer_fold_id", "y", "pred"), digits)


def run_single_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_run(spark, sf_dir, SingleModelRecipe("events", None, SPEC, columns=tuple(A))), "model", 5)


def run_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_run(spark, sf_dir, SingleModelRecipe("events", None, PER_ASSET, columns=tuple(A))), "model", 5)


def _own_scopes(spark: SparkSession, sf_dir: str) -> Run:
    """A run in which each asset has folds of its own, with scaled inputs and their drift."""
    base = SingleModelRecipe("events", None, PER_ASSET, columns=tuple(A)).nodes()[:-2]
    inputs = DiagnosticInputs(feature_tables=["features_baseline"], target_tables=["target_ret20"], fold_plans=["folds"])
    scaled = TransformNode("scaled", "features_baseline", "target_ret20", "folds", "scale", tuple(A))
    runner = Runner(spark, scratch(spark), {"events": TableVendor(lambda s: src.event_bars(s, sf_dir))})
    return load_run(spark, runner.root, runner.run(WorkflowGraph((*base, scaled, DiagnosticNode("drift", "feature_drift", inputs, tuple(A))))))


def scale_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs scaled by the asset's own training rows of each of its folds."""
    out = _own_scopes(spark, sf_dir).load_artifact("scaled", split_role="test")
    return rounded(out.select("asset", "bar_ts", "outer_fold_id", *A), 5)


def drift_per_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the inputs by asset and fold, known on the clock that all assets share."""
    out = _own_scopes(spark, sf_dir).load_artifact("drift")
    return rounded(out.select("asset", "outer_fold_id", "feature", "metric", "value", "known_at"), 5)


def run_nested_tuning(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir, NestedTuningRecipe("events", None, SPEC, inner=INNER, hyperopt=TWO, columns=tuple(A)))
    return rounded(run.load_inner_validation("model").select("outer_fold_id", "inner_fold_id", "candidate", F.col("value").alias("score")), 4)


def run_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    recipe = StackedModelRecipe("events", None, SPEC, tasks=("ret20", "vol20"), meta_task="ret40", columns=tuple(A), inner=INNER)
    return _told(_run(spark, sf_dir, recipe), "meta", 4)


def run_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required workflow as users run it: return 40 from inputs, predictions of two base models and the lagged health
    of both; errors by fold, as single predictions of collinear health columns hang on the last digits of their sums."""
    run = _run(spark, sf_dir, DiagnosticAwareMetaRecipe("events", None, SPEC, inner=INNER))
    made = diagnostics.regression_metrics(run.load_predictions("meta", split_role="test"), ["outer_fold_id"])
    return rounded(made.withColumn("r2", F.round("r2", 1)), 2)


def run_selector(spark: SparkSession, sf_dir: str) -> DataFrame:
    run = _run(spark, sf_dir, SelectorRecipe("events", None, SPEC, candidates={"a": tuple(A), "b": tuple(B)}))
    return rounded(run.load_artifact("selected", artifact_type="SelectionArtifact").select("outer_fold_id", "candidate", "score", "n_folds", "rank", "chosen", "weight"), 4)


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ancestors of each artifact in a graph like a stacked run's: nations hang on regions, suppliers on nations."""
    from foldspark.plans.inspect import ancestors

    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    edges = (
        nation.select(F.concat(F.lit("n"), "n_nationkey").alias("artifact_id"), F.concat(F.lit("r"), "n_regionkey").alias("upstream_id"))
        .unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("artifact_id"), F.concat(F.lit("n"), "s_nationkey").alias("upstream_id")))
        .unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("artifact_id"), F.lit("root").alias("upstream_id")))
    )
    return ancestors(edges)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        metrics_by_fold, bars_event_hourly, bars_order_daily, bars_part_daily, schema_normalise, universe_filter, time_index, feat_baseline, feat_cross_asset, feat_regime, feat_combined, feat_field, last_known, regression_by_asset,
        folds_expanding, folds_rolling, folds_nested, folds_per_asset, split_assign, fit_ridge_by_fold, fit_ridge_rolling, fit_ridge_per_asset, predict_ridge_per_asset, predict_ridge_by_fold,
        scale_train_only, clip_train_only, select_topk_corr, grid_inner_scores, grid_best, grid_two_params, grid_by_mae, oof_predictions, meta_required, meta_full, pca_by_fold, logit_by_fold, gbt_by_fold, isotonic, calibrated_by_fold,
        diag_gap, diag_drift_moments, diag_drift_quantile, diag_psi, diag_drift_corr, diag_resid_std, diag_disagreement, diag_coef_stability, diag_calibration, diag_calibration_regression, diag_residual_profile,
        metrics_rank_ic, metrics_classification, derived_resid_std, derived_health, derived_disagreement, project_health, project_by_asset,
        select_best_recent, blend_weights, select_diag_aware, select_regime, blend_predictions, subgroup_rollup, residuals_by_day, compare_feature_sets, corr_assets, run_single_model, run_per_asset, scale_per_asset, drift_per_asset, run_nested_tuning, run_stacked, run_required, run_selector, lineage,
    )
} | {
    "tgt_fwd_return": _target(tgt.forward_return), "tgt_fwd_vol": _target(tgt.forward_volatility), "tgt_updown": _target(tgt.up_down),
    "tgt_max_upside": _target(tgt.max_upside), "tgt_max_drawdown": _target(tgt.max_drawdown), "tgt_peak_to_trough": _target(tgt.peak_to_trough),
}
