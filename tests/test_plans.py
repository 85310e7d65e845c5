import json
from datetime import timedelta
from pathlib import Path

import numpy as np
import pytest
from helpers import START, bars
from pyspark.sql import functions as F

from foldspark.functions.targets import default_tasks
from foldspark.operators import leakage
from foldspark.operators.folds import ValidationSpec
from foldspark.plans import configs
from foldspark.plans import nodes as N
from foldspark.plans.artifacts import ArtifactScope, ArtifactType, GranularityError, ScopedFrame, join_scoped
from foldspark.plans.graph import GraphError, WorkflowGraph
from foldspark.plans.inspect import ancestors, load_run
from foldspark.plans.recipes import DiagnosticAwareMetaRecipe, FeatureComparisonRecipe, NestedTuningRecipe, SelectorRecipe, SingleModelRecipe, StackedModelRecipe, required_workflow
from foldspark.plans.runner import Runner
from foldspark.plans.specs import DiagnosticInputs, HyperoptSpec, ModelInputs, ModelSpec, TrainingRecipe
from foldspark.sources.bars import event_bars
from foldspark.sources.catalog import DataCatalog
from foldspark.sources.vendors import TableVendor, WalkBars

SF = "/root/testdata/sf0.001"
OUTER = ValidationSpec(min_train_size=200, test_size=120, embargo=20)
INNER = ValidationSpec(min_train_size=60, test_size=60, embargo=20)


@pytest.fixture(scope="module")
def runner(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("runs"))
    return Runner(spark, root, {"events": TableVendor(lambda s: event_bars(s, SF))}, cache=f"{root}-cache")


def done(runner, recipe):
    return load_run(runner.spark, runner.root, runner.run(recipe.compile()))


def test_single_model(runner):
    run = done(runner, SingleModelRecipe("events", None, OUTER, columns=("ret5", "vol20")))
    assert dict(run.list_nodes())["model"] == "ModelNode" and all(run.reconstructible().values())
    assert run.load_predictions("model", 0, "test").filter("outer_fold_id <> 0 or split_role <> 'test'").count() == 0
    assert run.load_artifact("model", artifact_type="ModelStateArtifact").filter("feature = 'ret5'").count() >= 2
    assert run.manifest["metrics"]["model"]["n"] > 0


def test_single_asset(runner):
    recipe = SingleModelRecipe("events", ("click",), ValidationSpec(min_train_size=60, test_size=40, embargo=20), columns=("ret5",))
    run = done(runner, recipe)
    assert run.load_artifact("bars").select("asset").distinct().count() == 1


def test_feature_comparison(runner):
    run = done(runner, FeatureComparisonRecipe("events", None, OUTER, sets={"base": [("baseline", {})], "both": [("baseline", {}), ("regime", {})]}))
    # The regime needs a longer past, so the larger set may serve fewer folds.
    assert run.load_artifact("metrics_base").filter("metric = 'rmse'").count() >= run.load_artifact("metrics_both").filter("metric = 'rmse'").count() > 0


def test_nested_tuning(runner):
    run = done(runner, NestedTuningRecipe("events", None, OUTER, inner=INNER, columns=("ret5", "vol20")))
    inner = run.load_inner_validation("model", 0)
    assert inner.select("alpha").distinct().count() == 3 and inner.filter("inner_fold_id is null").count() == 0
    snapshot = run.load_training_snapshot("model", 0)
    assert snapshot.filter("label_end_idx >= test_start").count() == 0 and snapshot.count() > 0


def test_stacked(runner):
    run = done(runner, StackedModelRecipe("events", None, OUTER, inner=INNER))
    base = run.load_predictions("ret20_model")
    assert {r[0] for r in base.select("split_role").distinct().collect()} == {"train", "oof", "test"}
    snapshot = run.load_training_snapshot("meta", 0)
    oof = base.filter("outer_fold_id = 0 and split_role = 'oof'").select("asset", "bar_ts", F.col("pred").alias("p"))
    both = snapshot.join(oof, ["asset", "bar_ts"], "left")
    assert both.filter("p is null or p <> pred_ret20_model").count() == 0


def test_required_workflow(runner):
    graph = required_workflow("events", validation=OUTER, inner=INNER)
    run = load_run(runner.spark, runner.root, runner.run(graph))
    meta = run.load_predictions("meta", split_role="test")
    assert meta.filter("pred is not null").count() > 0
    told = {n for _, n, _, _ in run.show_lineage("meta", meta.agg(F.min("outer_fold_id")).first()[0])}
    assert {"bars", "ret20_model", "vol20_model", "health", "drift", "gap_ret20_model", "resid_vol20_model"} <= told
    # A health value never shows at or before the time at which it was known.
    gap = run.load_artifact("gap_ret20_model").agg(F.min("known_at")).first()[0]
    rows = run.load_artifact("health").join(run.load_artifact("bars"), ["asset", "bar_ts"])
    assert rows.filter((F.col("t_idx") <= gap) & (F.col("gap_ret20_model_known") == 1)).count() == 0
    assert rows.filter((F.col("t_idx") > gap) & (F.col("gap_ret20_model_known") == 0)).count() == 0


@pytest.mark.parametrize("strategy", ["best_recent", "weighted_blend", "diagnostic_aware", "regime_conditioned"])
def test_selector(runner, strategy):
    run = done(runner, SelectorRecipe("events", None, ValidationSpec(min_train_size=200, test_size=60, embargo=20), strategy=strategy))
    assert run.load_artifact("selected", artifact_type="SelectionArtifact").count() > 0
    assert run.load_predictions("selected").filter("pred is null").count() == 0


def test_transform_derived_and_classifier(runner, spark):
    base = SingleModelRecipe("events", None, OUTER, task="updown20", columns=("ret5", "vol20")).nodes()[:-2]
    inputs = ModelInputs(["bars"], ["folds"], ["scaled"], ["target_updown20"])
    nodes = [
        *base,
        N.TransformNode("scaled", "features_baseline", "target_updown20", "folds", "scale", ("ret5", "vol20")),
        N.TransformNode("pca", "features_baseline", "target_updown20", "folds", "pca", ("ret5", "vol20", "mom20"), {"k": 2}),
        N.TransformNode("clip", "features_baseline", "target_updown20", "folds", "clip", ("ret5",)),
        N.TransformNode("select", "features_baseline", "target_updown20", "folds", "select", ("ret5", "vol20", "mom20"), {"k": 1}),
        N.ModelNode("logit", inputs, ModelSpec("logit", "logistic"), TrainingRecipe(INNER, generate_train_oof_predictions=True, calibration="isotonic"), "updown20"),
        N.DerivedFeatureNode("health", "model_health", N.DerivedInputs(["logit"], 20)),
        N.DiagnosticNode("calibration", "calibration_gap", DiagnosticInputs(["logit"]), task_type="classification"),
    ]
    run = load_run(spark, runner.root, runner.run(WorkflowGraph(tuple(nodes))))
    assert run.load_predictions("logit", split_role="test").filter("pred < 0 or pred > 1").count() == 0
    assert {"pc0", "pc1"} <= set(run.load_artifact("pca").columns) and run.load_artifact("health").count() > 0


def _late(spark, change_after=None):
    """Assets a and b; b is listed 150 hours later. ``change_after``: b is another from that hour on."""
    rng = np.random.default_rng(5)
    steps = {x: np.exp(np.cumsum(rng.normal(0, 0.01 if x == "a" else 0.05, 400))) * 100 for x in "ab"}
    closes = {"a": dict(enumerate(steps["a"].tolist())), "b": {150 + t: v for t, v in enumerate(steps["b"][:250].tolist())}}
    if change_after is not None:
        closes["b"] = {t: v if t <= change_after else 7.0 + (t * 37) % 11 for t, v in closes["b"].items()}
    return bars(spark, closes).drop("t_idx")


def _late_run(spark, root, table):
    own = ValidationSpec(min_train_size=60, test_size=30, embargo=20, mode="per_asset")
    base = SingleModelRecipe("events", None, own, columns=("ret5", "vol20")).nodes()[:-1]
    drift = N.DiagnosticNode("drift", "feature_drift", DiagnosticInputs(feature_tables=["features_baseline"], target_tables=["target_ret20"], fold_plans=["folds"]), ("ret5", "vol20"))
    gap = N.DiagnosticNode("gap", "train_test_deviance_gap", DiagnosticInputs(["model"]))
    stable = N.DiagnosticNode("stable", "coefficient_stability", DiagnosticInputs(model_states=["model"], fold_plans=["folds"]))
    made = [N.TransformNode(k, "features_baseline", "target_ret20", "folds", k, ("ret5", "vol20"), {"k": 1} if k in ("pca", "select") else {}) for k in ("scale", "clip", "pca", "select")]
    health = N.ProjectionNode("health", N.ProjectionInputs(["bars"], ["drift", "gap", "stable"]))
    runner = Runner(spark, str(root), {"events": TableVendor(lambda s: table)})
    return load_run(spark, runner.root, runner.run(WorkflowGraph((*base, *made, drift, gap, stable, health))))


def test_a_late_assets_future_changes_nothing_before(spark, tmp_path):
    t = 260
    a, b = _late_run(spark, tmp_path / "a", _late(spark)), _late_run(spark, tmp_path / "b", _late(spark, t))
    first = START + timedelta(hours=t)
    for name in ("scale", "clip", "pca", "select", "health"):
        rows = [r.load_artifact(name).filter(F.col("bar_ts") <= F.lit(first)) for r in (a, b)]
        kept = [sorted(map(str, (r if name == "health" else r.filter("split_role = 'test'")).collect())) for r in rows]
        assert kept[0] and kept[0] == kept[1], name
    known = {(r.asset, r.outer_fold_id): r.known_at for r in a.load_artifact("drift").select("asset", "outer_fold_id", "known_at").distinct().collect()}
    assert known["a", 0] == 109 and known["b", 0] == 150 + 109
    means = a.load_artifact("scale").filter("split_role = 'train'").groupBy("asset", "outer_fold_id").agg(F.avg("vol20").alias("m")).collect()
    assert len({r.asset for r in means}) == 2 and all(abs(r.m) < 1e-9 for r in means)


def test_pooled_statistics_of_plans_by_asset_are_refused(spark):
    rows = [("a", t, "train" if t < 60 else "test") for t in range(90)] + [("b", 150 + t, "train" if t < 60 else "test") for t in range(90)]
    frame = spark.createDataFrame(rows, "asset string, clock int, split_role string").withColumns({"outer_fold_id": F.lit(0), "clock_end": F.col("clock")})
    leakage.check_fitted(frame, ["asset", "outer_fold_id"])
    with pytest.raises(leakage.LeakageError):
        leakage.check_fitted(frame, ["outer_fold_id"])


@pytest.mark.parametrize("how", ["isotonic", "platt"])
def test_calibration_keeps_every_fold(runner, spark, how):
    base = SingleModelRecipe("events", None, ValidationSpec(min_train_size=100, test_size=60, embargo=20), task="updown20", columns=("ret5", "vol20")).nodes()[:-2]
    inputs = ModelInputs(["bars"], ["folds"], ["features_baseline"], ["target_updown20"])
    both = [
        N.ModelNode(n, inputs, ModelSpec(n, "logistic"), TrainingRecipe(INNER, generate_train_oof_predictions=True, calibration=c), "updown20", ("ret5", "vol20"))
        for n, c in (("plain", None), ("curved", how))
    ]
    run = load_run(spark, runner.root, runner.run(WorkflowGraph((*base, *both))))
    plain, curved = (run.load_predictions(n, split_role="test") for n in ("plain", "curved"))
    folds_ = lambda df: {r[0] for r in df.select("outer_fold_id").distinct().collect()}
    assert folds_(plain) == folds_(curved) and plain.count() == curved.count() and plain.filter("calibrated").isEmpty()
    with_oof = folds_(run.load_predictions("curved", split_role="oof"))
    assert folds_(curved.filter("calibrated")) == with_oof < folds_(curved)
    early = curved.filter("not calibrated").select("asset", "bar_ts", "outer_fold_id", "pred")
    assert early.count() and early.exceptAll(plain.select(*early.columns)).isEmpty()


def test_selection_by_regime_as_input(runner, spark):
    """A row of the meta model takes what was selected for its own regime."""
    base = SingleModelRecipe("events", None, OUTER, columns=("ret5", "vol20")).nodes()[:-2]
    inputs = ModelInputs(["bars"], ["folds"], ["features_baseline"], ["target_ret20"])
    training = TrainingRecipe(INNER, generate_train_oof_predictions=True)
    models_ = [N.ModelNode(n, inputs, ModelSpec(n, "ridge"), training, "ret20", c) for n, c in (("x", ("ret5", "vol20")), ("y", ("ret1", "mom20")))]
    choose = N.SelectionNode("selected", "regime_conditioned", N.SelectionInputs(["x", "y"], ["folds"], [], ["regime"]))
    meta = N.ModelNode("meta", ModelInputs(["bars"], ["folds"], [], ["target_ret20"], selection_tables=["selected"]), ModelSpec("meta", "ridge"), TrainingRecipe(save_training_snapshot=True), "ret20")
    run = load_run(spark, runner.root, runner.run(WorkflowGraph((*base, N.FeatureNode("regime", "bars", "regime"), *models_, choose, meta))))
    chosen = run.load_artifact("selected", artifact_type="SelectionArtifact").filter("chosen").select("outer_fold_id", "candidate", "regime")
    every = run.load_predictions("x").withColumn("candidate", F.lit("x")).unionByName(run.load_predictions("y").withColumn("candidate", F.lit("y"))).filter("split_role = 'oof'")
    regimes = run.load_artifact("regime").select("asset", "bar_ts", F.col("high_vol").alias("regime"))
    want = every.join(regimes, ["asset", "bar_ts"]).join(chosen, ["outer_fold_id", "candidate", "regime"]).select("asset", "bar_ts", "outer_fold_id", F.col("pred").alias("want"))
    snapshot = run.load_artifact("meta", artifact_type="TrainingDatasetSnapshotArtifact")
    both = snapshot.join(want, ["asset", "bar_ts", "outer_fold_id"], "left")
    assert snapshot.count() and both.filter("want is null or abs(want - pred_selected) > 1e-12").isEmpty()


def test_lineage_follows_pairs_not_paths(spark):
    layers = [(f"{k}.{i}", f"{k + 1}.{j}") for k in range(29) for i in range(5) for j in range(5)]
    got = ancestors(spark.createDataFrame([*layers, ("p", "q"), ("q", "p"), ("q", None)], "artifact_id string, upstream_id string")).collect()
    depth = {(r.artifact_id, r.ancestor_id): r.depth for r in got}
    assert len(got) == len(depth) == 25 * 29 * 30 // 2 + 4 and depth["0.0", "29.4"] == 29 and depth["p", "p"] == 2


def test_same_graph_same_ids(runner):
    recipe = SingleModelRecipe("events", None, OUTER, columns=("ret5",))
    a, b = done(runner, recipe), done(runner, recipe)
    ids = lambda r: sorted(x[0] for x in r.index.select("artifact_id").collect())
    assert ids(a) == ids(b) and a.manifest["metrics"] == b.manifest["metrics"]


def test_graph_json_round_trip():
    for recipe in (DiagnosticAwareMetaRecipe("events"), NestedTuningRecipe("events", hyperopt=HyperoptSpec("random", space={"alpha": [1.0]})), SelectorRecipe("events")):
        graph = recipe.compile()
        again = WorkflowGraph.from_json(graph.to_json())
        assert again.hash() == graph.hash() and again.validate()


def _model(**inputs):
    return N.ModelNode("m", ModelInputs(**{"fold_plans": ["folds"], "target_tables": ["t"], **inputs}), task_name="ret20")


def test_graphs_that_cannot_run():
    base = [N.DataNode("bars", "x"), N.FoldPlanNode("folds", "bars"), N.TargetNode("t", "bars", "ret20"), N.FeatureNode("f", "bars")]
    gap = N.DiagnosticNode("gap", "train_test_deviance_gap", DiagnosticInputs(["base"]))
    plain = N.ModelNode("base", ModelInputs(fold_plans=["folds"], target_tables=["t"], feature_tables=["f"]), task_name="ret20")
    with pytest.raises(GranularityError):
        WorkflowGraph((*base, plain, gap, _model(diagnostic_tables=["gap"]))).validate()
    with pytest.raises(GraphError, match="in-sample"):
        WorkflowGraph((*base, plain, _model(prediction_tables=["base"]))).validate()
    with pytest.raises(GraphError, match="no node"):
        WorkflowGraph((*base, _model(feature_tables=["none"]))).validate()
    with pytest.raises(GraphError, match="gives"):
        WorkflowGraph((*base, _model(feature_tables=["t"]))).validate()
    with pytest.raises(GraphError, match="one name"):
        WorkflowGraph((*base, base[0])).validate()
    with pytest.raises(GraphError, match="cycle"):
        WorkflowGraph((N.FeatureNode("a", "b"), N.FeatureNode("b", "a"))).order()
    with pytest.raises(ValueError):
        WorkflowGraph((*base, N.ModelNode("m", plain.inputs, ModelSpec("m", "lasso"), task_name="updown20"))).check_tasks(default_tasks())
    with pytest.raises(ValueError):
        TrainingRecipe(generate_train_oof_predictions=True)


def test_fold_level_tables_do_not_meet_rows(spark):
    rows = ScopedFrame(spark.createDataFrame([("a", 1)], "asset string, bar_ts int"), ArtifactType.FEATURES)
    fold = ScopedFrame(spark.createDataFrame([("n", 0)], "node string, outer_fold_id int"), ArtifactType.DIAGNOSTICS)
    with pytest.raises(GranularityError):
        join_scoped(rows, fold)
    with pytest.raises(ValueError):
        ArtifactScope("outer_fold", "test")
    with pytest.raises(ValueError):
        ArtifactScope("global", "none")


def test_catalog(spark, tmp_path):
    catalog = DataCatalog(spark, str(tmp_path))
    catalog.save(event_bars(spark, SF), "bars", "raw", "events")
    second = catalog.save(event_bars(spark, SF).limit(5), "bars", "raw")
    assert second.version == 2 and catalog.load("bars", "raw").count() == 5 and catalog.load("bars", "raw", 1).count() == catalog.find("bars", "raw", 1).rows
    catalog.export_csv("bars", str(tmp_path / "csv"), "raw")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 5
    with pytest.raises(KeyError):
        catalog.find("none")
    with pytest.raises(ValueError):
        catalog.save(spark.range(1), "x", "other")


def test_walk_bars_source(spark):
    spark.dataSource.register(WalkBars)
    rows = spark.read.format("walk_bars").option("assets", 2).option("bars", 7).load()
    assert rows.count() == 14 and rows.filter("high < low").count() == 0


def test_runs_from_configurations(runner, spark, caplog):
    folder = Path(__file__).resolve().parents[1] / "configs"
    graphs = {p.stem: configs.read(spark, str(p)).compile() for p in sorted(folder.glob("*.json"))}
    assert len(graphs) == 4 and graphs["required_workflow"].hash() == required_workflow("events", validation=ValidationSpec(), inner=ValidationSpec(min_train_size=120, test_size=50)).hash()
    told = json.loads((folder / "per_asset_classifier.json").read_text())
    told["validation"] |= {"min_train_size": 150, "test_size": 100}
    told["training"]["selection_validation"] |= {"min_train_size": 60}
    with caplog.at_level("INFO", "foldspark.run"):
        run = done(runner, configs.recipe_of(told))
    assert {r[0] for r in run.load_predictions("model", split_role="test").select("calibrated").distinct().collect()} <= {True, False}
    assert run.load_predictions("model").filter("pred < 0 or pred > 1").isEmpty() and any("model (ModelNode) in" in r.message for r in caplog.records)
    for bad in ({"recipe": "None"}, {"recipe": "SelectorRecipe", "source": "x", "colour": 1}, {"recipe": "SingleModelRecipe", "source": "x", "validation": {"size": 3}}):
        with pytest.raises(ValueError):
            configs.recipe_of(bad)
