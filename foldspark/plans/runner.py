"""Runs a graph node by node; each node's artifacts are written before the next reads them."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspark.functions.features import FeatureRegistry, by_asset, default_registry
from foldspark.functions.targets import TaskRegistry, default_tasks
from foldspark.operators import calibration, derived, diagnostics, folds, models, projection, ridge, selection, transforms, tuning
from foldspark.operators.chunks import in_chunks
from foldspark.operators.leakage import check_fitted, check_purged
from foldspark.operators.lineage import cut
from foldspark.plans import nodes as N
from foldspark.plans.artifacts import ArtifactType as A
from foldspark.plans.artifacts import ScopedFrame, join_scoped
from foldspark.plans.graph import GraphError, WorkflowGraph
from foldspark.plans.store import RunWriter
from foldspark.sources import files
from foldspark.sources.bars import with_time_index
from foldspark.sources.vendors import Vendor

log = logging.getLogger("foldspark.run")

SCOPE = ["outer_fold_id", "split_role"]
PRED = ["asset", "bar_ts", "t_idx", "outer_fold_id", "split_role", "y", "label_end_idx", "pred", "calibrated"]


class Runner:
    """Vendors by name, registries of features and tasks, and where runs are kept. With ``chunk_rows``
    features and targets of long series are computed in chunks of about so many bars."""

    def __init__(self, spark: SparkSession, root: str, vendors: Mapping[str, Vendor], features: FeatureRegistry | None = None, tasks: TaskRegistry | None = None, cache: str | None = None, chunk_rows: int | None = None):
        self.spark, self.root, self.vendors, self.cache, self.chunk_rows = spark, root, vendors, cache, chunk_rows
        self.features, self.tasks = features or default_registry(), tasks or default_tasks()

    def run(self, graph: WorkflowGraph, config: dict | None = None, run_id: str | None = None) -> str:
        """The run's id."""
        graph.validate().check_tasks(self.tasks)
        for node in graph.nodes:
            if isinstance(node, N.ModelNode) and node.training.hyperopt:
                hyperopt = node.training.hyperopt
                diagnostics.mean_loss(hyperopt.objective)
                models.check_params(models.REGISTRY[node.model.algorithm], sorted({n for c in hyperopt.candidates() for n in c}))
        self.writer = RunWriter(self.spark, self.root, graph, config or self._config(graph), run_id)
        self.made: dict[tuple[str, A], DataFrame] = {}
        self.contents: dict[str, str] = {}
        self.ids: dict[str, list[str]] = {}
        self.graph = graph
        log.info("run %s: %d nodes", self.writer.run_id, len(graph.nodes))
        for node in graph.order():
            start = time.monotonic()
            try:
                getattr(self, f"_{type(node).__name__}")(node)
            except Exception as e:
                log.error("run %s: %s failed: %s", self.writer.run_id, node.name, e)
                self.writer.fail(node.name, e)
                raise
            log.info("run %s: %s (%s) in %.1f s", self.writer.run_id, node.name, type(node).__name__, time.monotonic() - start)
        self.writer.finish(self._metrics())
        log.info("run %s: finished", self.writer.run_id)
        return self.writer.run_id

    def _config(self, graph: WorkflowGraph) -> dict:
        """What a run depends on besides its graph and the code."""
        used = {n.family for n in graph.nodes if isinstance(n, N.FeatureNode)}
        tasks = {n.task_name for n in graph.nodes if isinstance(n, N.TargetNode)}
        told = lambda t: {k: getattr(t, k) for k in ("name", "task_type", "horizon", "metrics", "embargo")}
        return {
            "recipe": graph.origin,
            "vendors": {n.source: type(self.vendors[n.source]).__name__ for n in graph.nodes if isinstance(n, N.DataNode)},
            "features": {f: {"class": type(self.features.get(f)).__name__, "version": self.features.get(f).version} for f in sorted(used)},
            "tasks": {t: told(self.tasks.get(t)) for t in sorted(tasks)},
            "time_zone": self.spark.conf.get("spark.sql.session.timeZone"),
        }

    # -- what nodes share ------------------------------------------------------------

    def _put(self, node: N.Node, what: A, df: DataFrame, /, **metadata: str) -> None:
        before = len(self.writer.refs)
        upstream = sorted({i for name, _ in node.needs() for i in self.ids.get(name, [])})
        self.made[node.name, what] = self.writer.put(df, node.name, what, upstream, metadata)
        self.ids.setdefault(node.name, []).extend(r.artifact_id for r in self.writer.refs[before:])

    def _get(self, name: str, kind: A) -> DataFrame:
        return self.made[name, kind]

    def _gap(self, node: N.FoldPlanNode) -> int:
        """The larger of the validation's embargo and those of the tasks in the graph."""
        tasks = [self.tasks.get(n.task_name) for n in self.graph.nodes if isinstance(n, N.TargetNode)]
        return max([node.gap, node.validation.embargo, *(t.embargo for t in tasks)])

    def _plan_gap(self, name: str) -> int:
        return self._gap(self.graph.node(name))

    def _metrics(self) -> dict:
        """Test metrics of each model, those that its task names, for the manifest."""
        out = {}
        for (name, kind), df in self.made.items():
            if kind is A.PREDICTIONS:
                scored = df.filter("split_role = 'test' and y is not null and pred is not null").withColumn("_all", F.lit(0))
                node = self.graph.node(name)
                task = self.tasks.get(node.task_name) if isinstance(node, N.ModelNode) else None
                make = diagnostics.classification_metrics if task and task.task_type == "classification" else diagnostics.regression_metrics
                row = make(scored, ["_all"]).first()
                mse = scored.agg(F.avg(diagnostics.squared_error())).first()[0]
                named = {m: row[m] for m in task.metrics if m in row} if task and row else {}
                out[name] = {"n": row["n"] if row else 0, "mse": mse, **named}
        return out

    def _predictions(self, name: str) -> DataFrame:
        return self._get(name, A.PREDICTIONS)

    def _own_index(self) -> DataFrame:
        """(asset, bar_ts, t_idx, own): the place of each bar among its asset's own, which per-asset plans count."""
        bars = self._get(next(n.name for n in self.graph.nodes if isinstance(n, N.DataNode)), A.BARS)
        return bars.select("asset", "bar_ts", "t_idx", (F.row_number().over(by_asset()) - 1).cast("int").alias("own"))

    def _on_plan(self, rows: DataFrame, plan: DataFrame) -> DataFrame:
        """``rows`` with t_idx and label_end_idx on the index of the plan; clock and clock_end keep those that all assets share."""
        rows = rows.withColumns({"clock": F.col("t_idx"), "clock_end": F.col("label_end_idx")})
        if "asset" not in plan.columns:
            return rows
        own = self._own_index()
        here = own.select("asset", "bar_ts", F.col("own").alias("_own"))
        end = own.select("asset", F.col("t_idx").alias("label_end_idx"), F.col("own").alias("_end"))
        out = rows.join(here, ["asset", "bar_ts"]).join(end, ["asset", "label_end_idx"], "left")
        return out.withColumns({"t_idx": F.col("_own"), "label_end_idx": F.col("_end")}).drop("_own", "_end").select(*rows.columns)

    def _off_plan(self, rows: DataFrame, plan: DataFrame, targets: str) -> DataFrame:
        """Back on the shared index."""
        if "asset" not in plan.columns:
            return rows
        shared = self._get(targets, A.TARGETS).select("asset", "bar_ts", "t_idx", "label_end_idx")
        return rows.drop("t_idx", "label_end_idx").join(shared, ["asset", "bar_ts"]).select(*rows.columns)

    def _starts(self, name: str) -> DataFrame:
        """(scope, test_start) on the shared index."""
        plan = self._get(name, A.FOLDS)
        if "asset" not in plan.columns:
            return plan.select("outer_fold_id", "test_start")
        own = self._own_index().select("asset", F.col("own").alias("test_start"), "t_idx")
        return plan.join(own, ["asset", "test_start"]).select("asset", "outer_fold_id", F.col("t_idx").alias("test_start"))

    def _test_starts(self, name: str) -> DataFrame:
        """(outer_fold_id, test_start) on the shared index; of plans by asset the earliest."""
        return self._starts(name).groupBy("outer_fold_id").agg(F.min("test_start").alias("test_start"))

    def _scope(self, name: str) -> list[str]:
        """What the folds of a model's or selection's predictions are told apart by."""
        return folds.scope(self._get(self.graph.node(name).inputs.fold_plans[0], A.FOLDS))

    # -- nodes -------------------------------------------------------------------------

    def _DataNode(self, node: N.DataNode) -> None:
        bars = self.vendors[node.source].bars(self.spark, list(node.assets) if node.assets else None)
        self._put(node, A.BARS, with_time_index(bars), source=node.source)

    def _TargetNode(self, node: N.TargetNode) -> None:
        task = self.tasks.get(node.task_name)
        bars = self._get(node.bars, A.BARS)
        table = in_chunks(bars, task.table, 1, task.horizon, self.chunk_rows) if self.chunk_rows else task.table(bars)
        self._put(node, A.TARGETS, table, task=task.name, horizon=str(task.horizon))

    def _FoldPlanNode(self, node: N.FoldPlanNode) -> None:
        if node.level == "outer":
            plan = folds.outer_folds(self._get(node.bars, A.BARS), node.validation, self._gap(node))
        else:
            plan = folds.inner_folds(self._get(str(node.outer), A.FOLDS), node.validation, self._gap(node))
        self._put(node, A.FOLDS, plan, level=node.level)

    def _FeatureNode(self, node: N.FeatureNode) -> None:
        key = self.features.param_hash(node.family, node.params)
        family, bars = self.features.get(node.family), self._get(node.bars, A.BARS)
        memory = family.memory(node.params) if self.chunk_rows else None
        table = family.apply(bars, node.params) if memory is None else in_chunks(bars, lambda b: family.apply(b, node.params), memory, rows=self.chunk_rows)
        if self.cache:
            # Reused by later runs over the same bars, named by family, parameters and the bars' content.
            path = files.join(self.cache, node.family, f"{key}-{self._content(node.bars)}")
            if not files.complete(self.spark, path):
                table.write.mode("overwrite").parquet(path)
            table = self.spark.read.parquet(path)
        self._put(node, A.FEATURES, table, family=node.family, param_hash=key)

    def _content(self, bars: str) -> str:
        """Of the bars' rows, whatever their order and partitions."""
        if bars not in self.contents:
            table = self._get(bars, A.BARS)
            columns = sorted(table.columns)
            a, b = (F.sum(F.xxhash64(*columns, F.lit(salt)).cast("decimal(38,0)")) for salt in (0, 1))
            told = table.agg(F.count(F.lit(1)), a, b).first()
            self.contents[bars] = hashlib.sha256(f"{columns}{tuple(told)}".encode()).hexdigest()[:16]
        return self.contents[bars]

    def _roles(self, node: N.TransformNode | N.DiagnosticNode, features: str, targets: str, plan: str) -> DataFrame:
        rows = join_scoped(ScopedFrame(self._get(features, A.FEATURES), A.FEATURES), ScopedFrame(self._get(targets, A.TARGETS), A.TARGETS)).df
        out = folds.assign(self._on_plan(rows, self._get(plan, A.FOLDS)), self._get(plan, A.FOLDS), self._plan_gap(plan))
        check_purged(out)
        check_fitted(out, folds.scope(self._get(plan, A.FOLDS)))
        return out

    def _TransformNode(self, node: N.TransformNode) -> None:
        rows = self._roles(node, node.features, node.targets, node.folds).filter("split_role <> 'embargo'")
        columns, keys = list(node.columns), folds.scope(self._get(node.folds, A.FOLDS))
        keep = ["asset", "bar_ts", *SCOPE]
        if node.kind == "scale":
            out = transforms.standardise(rows, columns, keys).select(*keep, *columns)
        elif node.kind == "clip":
            out = transforms.winsorise(rows, columns, **node.params, keys=keys).select(*keep, *columns)
        elif node.kind == "pca":
            k = int(node.params.get("k", 2))
            out = transforms.project(rows, transforms.components(rows, columns, k, keys), columns, k, keys).select(*keep, *(f"pc{c}" for c in range(k)))
        elif node.kind == "select":
            # Features not chosen in a fold are constant there, so every fold has the same columns.
            chosen = transforms.top_correlated(rows, columns, int(node.params.get("k", 3)), keys=keys).groupBy(*keys).agg(F.collect_set("feature").alias("_chosen"))
            out = rows.join(chosen, keys).select(*keep, *(F.when(F.array_contains("_chosen", c), F.col(c)).otherwise(0.0).alias(c) for c in columns))
        else:
            raise GraphError(f"no transform {node.kind}")
        self._put(node, A.FEATURES, out, kind=node.kind)

    def _matrix(self, node: N.ModelNode) -> tuple[DataFrame, list[str], bool]:
        """(rows with all inputs and the target, input names, whether rows carry their fold)."""
        target = ScopedFrame(self._get(node.inputs.target_tables[0], A.TARGETS), A.TARGETS)
        rows, names = target, []
        scoped = False
        for name in node.inputs.feature_tables if node.inputs.use_base_features else [n for n in node.inputs.feature_tables if not isinstance(self.graph.node(n), N.FeatureNode)]:
            table = self._get(name, A.FEATURES)
            keys = {"asset", "bar_ts", "t_idx", *SCOPE}
            names += [c for c in table.columns if c not in keys]
            both = {"outer_fold_id", "split_role"} <= set(rows.df.columns) and "split_role" in table.columns
            scoped = scoped or "outer_fold_id" in table.columns
            joined = join_scoped(rows, ScopedFrame(table.drop("t_idx", *(["split_role"] if both else [])), A.FEATURES))
            rows = ScopedFrame(joined.df, A.TARGETS)
        for name in node.inputs.prediction_tables:
            # Training rows take out-of-fold predictions, test rows those of refitted models.
            column = f"pred_{name}"
            table = self._get(name, A.PREDICTIONS).filter("split_role in ('oof', 'test')").select("asset", "bar_ts", "outer_fold_id", F.col("pred").alias(column))
            names.append(column)
            rows = ScopedFrame(join_scoped(rows, ScopedFrame(table, A.FEATURES)).df, A.TARGETS)
            scoped = True
        for name in node.inputs.selection_tables:
            # What was selected for a fold, known before its test: its candidates' predictions by weight.
            column, sources = f"pred_{name}", self.graph.node(name).inputs.prediction_tables
            weights = self._get(name, A.SELECTION).filter("weight > 0")
            by = [c for c in ("outer_fold_id", "candidate", "regime") if c in weights.columns]
            every = reduce(DataFrame.unionByName, [self._predictions(n).filter("split_role in ('oof', 'test')").withColumn("candidate", F.lit(n)) for n in sources])
            if "regime" in by:  # a row takes what was selected for its own regime
                every = every.join(self._regimes(name), ["asset", "bar_ts"])
            mean = F.try_divide(F.sum(F.col("weight") * F.col("pred")), F.sum("weight")).alias(column)
            table = every.join(weights.select(*by, "weight"), by).groupBy("asset", "bar_ts", "outer_fold_id").agg(mean)
            names.append(column)
            rows = ScopedFrame(join_scoped(rows, ScopedFrame(table, A.FEATURES)).df, A.TARGETS)
            scoped = True
        return rows.df.drop("split_role"), [c for c in names if not node.columns or c in node.columns], scoped

    def _regimes(self, name: str) -> DataFrame:
        """(asset, bar_ts, regime) of a selection by regime."""
        return self._get(self.graph.node(name).inputs.regime_tables[0], A.FEATURES).select("asset", "bar_ts", F.col("high_vol").alias("regime"))

    def _ModelNode(self, node: N.ModelNode) -> None:
        rows, names, scoped = self._matrix(node)
        plan_name, target = node.inputs.fold_plans[0], node.inputs.target_tables[0]
        plan, gap = self._get(plan_name, A.FOLDS), self._plan_gap(plan_name)
        rows = cut(self._on_plan(rows, plan))
        task, training = self.tasks.get(node.task_name), node.training
        algorithm = models.algorithm(node.model.algorithm, task.task_type)
        fit = _Fits(self, node, rows, plan, names, gap, scoped, task, algorithm)
        check_purged(fit.roles)
        if training.save_training_snapshot:
            self._put(node, A.SNAPSHOT, fit.roles.filter("split_role = 'train'"))
        best = None
        if training.hyperopt:
            scores = fit.scores(training.hyperopt.objective)
            told = F.array(*(F.lit(json.dumps(c, sort_keys=True)) for c in fit.candidates))
            alpha = F.array(*(F.lit(float(c["alpha"]) if "alpha" in c else None).cast("double") for c in fit.candidates))
            by = [c for c in ("asset",) if c in scores.columns]
            scores = scores.select(
                F.lit(node.name).alias("node"), *by, "outer_fold_id", "inner_fold_id", "candidate", told[F.col("candidate")].alias("params"), alpha[F.col("candidate")].alias("alpha"),
                F.lit(f"inner_{training.hyperopt.objective}").alias("metric"), F.col("score").alias("value"), F.lit(None).cast("int").alias("known_at"),
            )
            self._put(node, A.DIAGNOSTICS, scores, kind="inner_validation")
            best = tuning.best_candidates(self._get(node.name, A.DIAGNOSTICS).withColumnRenamed("value", "score"))
        preds, state = fit.outer(best)
        preds = preds.withColumn("calibrated", F.lit(False))
        if training.generate_train_oof_predictions or training.calibration:
            inner, inner_state = fit.inner_best(best)
            keep = ["asset", "bar_ts", "t_idx", "outer_fold_id", "inner_fold_id", "y", "label_end_idx", "pred"]
            self._put(node, A.INNER_PREDICTIONS, self._off_plan(inner.select(*keep), plan, target), kind="validation")
            self._put(node, A.INNER_STATE, inner_state, algorithm=algorithm.name)
            oof = self._get(node.name, A.INNER_PREDICTIONS).drop("inner_fold_id").withColumns({"split_role": F.lit("oof"), "calibrated": F.lit(False)})
            preds = self._off_plan(preds.select(*PRED), plan, target).unionByName(oof.select(*PRED))
        else:
            preds = self._off_plan(preds.select(*PRED), plan, target)
        if training.calibration:
            preds = self._calibrated(preds, training.calibration, fit.keys)
        self._put(node, A.PREDICTIONS, preds, task=task.name, algorithm=algorithm.name)
        self._put(node, A.MODEL_STATE, state, algorithm=algorithm.name)

    def _calibrated(self, preds: DataFrame, how: str, keys: list[str]) -> DataFrame:
        """Test predictions of each fold on a curve fitted on its out-of-fold ones. Folds too early to have
        out-of-fold predictions keep what their model says, and ``calibrated`` says so."""
        preds = cut(preds)
        test, oof = (preds.filter(F.col("split_role") == r) for r in ("test", "oof"))
        curved = calibration.CURVES[how](oof, test, keys)
        curved = curved.withColumns({"calibrated": F.col("proba").isNotNull(), "pred": F.coalesce("proba", "pred")}).select(*PRED)
        return preds.filter("split_role <> 'test'").unionByName(curved)

    def _DiagnosticNode(self, node: N.DiagnosticNode) -> None:
        i = node.inputs
        metric = node.kind
        if metric == "train_test_deviance_gap":
            out = diagnostics.deviance_gap(self._judged(i.prediction_tables[0], ("train", "test")), node.task_type, self._scope(i.prediction_tables[0]))
        elif metric == "residual_std_by_asset":
            out = diagnostics.residual_std(self._judged(i.prediction_tables[0], ("test",)))
        elif metric == "calibration_gap":
            scored = self._judged(i.prediction_tables[0], ("test",))
            keys = self._scope(i.prediction_tables[0])
            made = diagnostics.calibration_gap(scored, keys=keys) if node.task_type == "classification" else diagnostics.regression_calibration_gap(scored, keys)
            out = made.join(scored.groupBy(*keys).agg(diagnostics.known_at()), keys)
        elif metric == "prediction_disagreement":
            each = [self._judged(n, ("test",)).withColumn("candidate", F.lit(n)) for n in i.prediction_tables]
            scored = reduce(DataFrame.unionByName, each)
            keys = self._scope(i.prediction_tables[0])
            out = diagnostics.disagreement(scored, keys).join(scored.groupBy(*keys).agg(F.max("t_idx").alias("known_at")), keys)
        elif metric == "coefficient_stability":
            state = self._get(i.model_states[0], A.MODEL_STATE)
            keys = folds.scope(self._get(i.fold_plans[0], A.FOLDS))
            plan = self._starts(i.fold_plans[0]).select(*keys, (F.col("test_start") - 1).alias("known_at"))
            out = diagnostics.coefficient_stability(state).withColumnRenamed("change", "value").join(plan, keys)
        elif metric == "feature_drift":
            # Inputs are known at once: a fold's drift is known when its test ends.
            rows = self._roles(node, i.feature_tables[0], i.target_tables[0], i.fold_plans[0])
            rows = cut(rows.select("asset", "outer_fold_id", "split_role", "clock", *node.columns))
            columns, keys = list(node.columns), folds.scope(self._get(i.fold_plans[0], A.FOLDS))
            known = rows.filter("split_role = 'test'").groupBy(*keys).agg(F.max("clock").alias("known_at"))
            moments = diagnostics.drift_moments(rows, columns, keys)
            long = moments.unpivot([*keys, "feature"], ["mean_shift", "std_ratio"], "metric", "value")
            long = long.unionByName(diagnostics.psi(rows, columns, keys=keys).select(*keys, "feature", F.lit("psi").alias("metric"), F.col("psi").alias("value")))
            quantiles = diagnostics.drift_quantiles(rows, columns, keys=keys)
            long = long.unionByName(quantiles.unpivot([*keys, "feature"], ["shift_10", "shift_50", "shift_90"], "metric", "value"))
            if len(columns) > 1:
                long = long.unionByName(diagnostics.drift_correlation(rows, columns, keys).select(*keys, F.lit("*").alias("feature"), F.lit("corr_change").alias("metric"), F.col("corr_change").alias("value")))
            self._put(node, A.DIAGNOSTICS, long.join(known, keys).withColumn("node", F.lit(node.name)), kind=metric)
            return
        elif metric == "metrics":
            scored = self._judged(i.prediction_tables[0], ("test",))
            keys = self._scope(i.prediction_tables[0])
            wide = (diagnostics.regression_metrics if node.task_type == "regression" else diagnostics.classification_metrics)(scored, keys)
            names = [c for c, t in wide.dtypes if t == "double"]
            out = wide.unpivot(keys, names, "metric", "value").join(scored.groupBy(*keys).agg(diagnostics.known_at()), keys)
            self._put(node, A.DIAGNOSTICS, out.withColumn("node", F.lit(node.name)), kind=metric)
            return
        else:
            raise GraphError(f"no diagnostic {metric}")
        out = out.drop("metric").withColumn("metric", F.lit(metric)).withColumn("node", F.lit(node.name))
        self._put(node, A.DIAGNOSTICS, out, kind=metric)

    def _judged(self, name: str, roles: tuple[str, ...]) -> DataFrame:
        return self._get(name, A.PREDICTIONS).filter(F.col("split_role").isin(*roles) & F.col("y").isNotNull() & F.col("pred").isNotNull())

    def _DerivedFeatureNode(self, node: N.DerivedFeatureNode) -> None:
        tables = node.inputs.prediction_tables
        if node.kind == "disagreement":
            rows = reduce(DataFrame.unionByName, [self._get(n, A.PREDICTIONS).filter("split_role = 'test'").withColumn("candidate", F.lit(n)) for n in tables])
            out = derived.disagreement(rows).drop("outer_fold_id")
        else:
            make = {"residual_std": derived.residual_std, "model_health": derived.model_health}[node.kind]
            out = make(self._get(tables[0], A.PREDICTIONS).filter("split_role = 'test'"), node.inputs.horizon)
        self._put(node, A.FEATURES, out, kind=node.kind)

    def _ProjectionNode(self, node: N.ProjectionNode) -> None:
        rows = self._get(node.inputs.bars[0], A.BARS).select("asset", "bar_ts", "t_idx")
        for name in node.inputs.diagnostic_tables:
            table = self._get(name, A.DIAGNOSTICS)
            by = "asset" if "asset" in table.columns else None
            if "feature" in table.columns:
                table = table.withColumn("metric", F.concat_ws("_", "metric", "feature"))
            metrics = sorted(r[0] for r in table.select("metric").distinct().collect())
            wide = table.groupBy("outer_fold_id", "known_at", *([by] if by else [])).pivot("metric", metrics).agg(F.first("value"))
            names = {m: f"{name}_{m}".replace("*", "all") for m in metrics}
            wide = wide.withColumnsRenamed(names)
            rows = projection.project_asof(rows, wide, list(names.values()), node.lag_folds, by).withColumnRenamed("has_health", f"{name}_known")
            # Nothing known yet reads as 0, and the flag says so.
            rows = rows.fillna(0.0, list(names.values()))
        self._put(node, A.FEATURES, rows.drop("t_idx"), kind="projected")

    def _SelectionNode(self, node: N.SelectionNode) -> None:
        i = node.inputs
        rows = reduce(DataFrame.unionByName, [self._judged(n, ("test",)).withColumn("candidate", F.lit(n)) for n in i.prediction_tables])
        start = self._test_starts(i.fold_plans[0])
        by: list[str] = []
        if node.strategy == "regime_conditioned":
            rows = rows.join(self._regimes(node.name), ["asset", "bar_ts"])
            by = ["regime"]
        scores = rows.groupBy(*by, "candidate", "outer_fold_id").agg(diagnostics.mean_loss(node.metric).alias("score"), diagnostics.known_at()).join(start, "outer_fold_id")
        k = node.recent_folds
        if node.strategy == "best_recent":
            out = selection.best_recent(scores, k)
        elif node.strategy == "weighted_blend":
            out = selection.blend_weights(scores, k)
        elif node.strategy == "regime_conditioned":
            out = selection.by_regime(scores, k)
        elif node.strategy == "diagnostic_aware":
            # A scaffold: each candidate's gap of deviance is added to its score.
            gaps = reduce(DataFrame.unionByName, [self._get(d, A.DIAGNOSTICS).select("outer_fold_id", F.abs("value").alias("penalty"), "known_at", F.lit(n).alias("candidate")) for d, n in zip(i.diagnostic_tables, i.prediction_tables)])
            out = selection.diagnostic_aware(scores, gaps.join(start, "outer_fold_id"), 1.0, k)
        else:
            raise GraphError(f"no selection {node.strategy}")
        self._put(node, A.SELECTION, out, strategy=node.strategy)
        weights = self._get(node.name, A.SELECTION)
        every = reduce(DataFrame.unionByName, [self._get(n, A.PREDICTIONS).filter("split_role = 'test'").withColumn("candidate", F.lit(n)) for n in i.prediction_tables])
        if by:
            chosen = every.join(self._regimes(node.name), ["asset", "bar_ts"]).join(weights.filter("chosen").select("outer_fold_id", "candidate", "regime"), ["outer_fold_id", "candidate", "regime"])
            blended = chosen.select("outer_fold_id", "asset", "bar_ts", "y", "pred")
        else:
            blended = selection.apply_weights(every, weights)
        places = every.select("asset", "bar_ts", "outer_fold_id", "t_idx", "label_end_idx").distinct()
        self._put(node, A.PREDICTIONS, blended.join(places, ["asset", "bar_ts", "outer_fold_id"]).withColumns({"split_role": F.lit("test"), "calibrated": F.lit(False)}).select(*PRED), strategy=node.strategy)


class _Fits:
    """The fits of one model node: its candidates on inner folds, and those chosen on outer ones.

    Models that are fitted by sums are so in every case; where rows differ by fold (they
    carry predictions), sums are kept by fold.  Others go through one MLlib fit a fold.
    """

    def __init__(self, runner: Runner, node: N.ModelNode, rows: DataFrame, plan: DataFrame, names: list[str], gap: int, scoped: bool, task, algorithm):
        self.spark, self.node, self.rows, self.plan, self.names, self.gap, self.scoped, self.task, self.algorithm = runner.spark, node, rows, plan, names, gap, scoped, task, algorithm
        self.keys = [c for c in ("asset", "outer_fold_id") if c in plan.columns]
        self.spec = node.training.selection_validation
        base = dict(node.model.params) | ({"alpha": 0.0} if algorithm.name == "ols" else {})
        hyperopt = node.training.hyperopt
        self.candidates: list[dict] = [{**base, **c} for c in (hyperopt.candidates() if hyperopt else [{}])]
        self.plan_inner = folds.inner_folds(plan, self.spec, gap) if self.spec else None
        self.roles = self._roles()

    # -- rows and folds ------------------------------------------------------------------

    def _near(self, plan: DataFrame) -> DataFrame:
        """Rows by the folds whose span holds them; rows that carry a fold meet only that one."""
        return folds.meet(self.rows, plan, "train_start", "test_end", on=("asset", "outer_fold_id") if self.scoped else ("asset",))

    def _fit_plan(self) -> DataFrame:
        """The plan that outer fits train by: without a refit, up to the test of the last inner fold."""
        if self.node.training.refit_on_full_outer_train:
            return self.plan
        last = self.plan_inner.groupBy(*self.keys).agg(F.max("test_start").alias("test_start"))
        return self.plan.drop("test_start").join(last, self.keys).select(*self.plan.columns)

    def _roles(self) -> DataFrame:
        before = self._fit_plan().select(*self.keys, F.col("test_start").alias("_fit_before"))
        both = self._near(self.plan.join(before, self.keys))
        trains = folds.in_train(self.gap) & (folds.eligible(self.gap) < F.col("_fit_before"))
        return both.withColumn("split_role", F.when(folds.in_test(), "test").when(trains, "train").otherwise("embargo")).filter("split_role <> 'embargo'").drop("_fit_before")

    # -- sums ----------------------------------------------------------------------------

    def _sums(self, plan: DataFrame, role: str = "train") -> DataFrame:
        cell_keys = [k for k in ("asset", "outer_fold_id") if k in plan.columns and (k == "asset" or self.scoped)]
        made = ridge.cells(self.rows, self.names, "y", self.gap, cell_keys)
        if not self.scoped:
            return ridge.fold_sums(made, plan, role)
        at = F.col("t_idx")
        inside = (at >= F.col("train_start")) & (F.col("e") < F.col("test_start")) if role == "train" else (at >= F.col("test_start")) & (at < F.col("test_end"))
        keys = [c for c in ("asset", "outer_fold_id", "inner_fold_id") if c in plan.columns]
        sums = [c for c in made.columns if c not in (*cell_keys, "t_idx", "e")]
        return made.join(plan, cell_keys).filter(inside).groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

    def _apply(self, roles: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
        pred = F.col("intercept")
        for i, f in enumerate(self.names):
            pred = pred + F.col("coefs")[i] * F.col(f)
        return roles.join(fits.drop("n_train", "alpha"), keys).withColumn("pred", pred).filter("pred is not null").drop("intercept", "coefs")

    # -- inner folds ---------------------------------------------------------------------

    def _inner_roles(self) -> DataFrame:
        both = self._near(self.plan_inner)
        return both.withColumn("split_role", F.when(folds.in_test(), "test").when(folds.in_train(self.gap), "train").otherwise("embargo"))

    @property
    def _inner_keys(self) -> list[str]:
        return [*self.keys, "inner_fold_id"]

    def scores(self, objective: str) -> DataFrame:
        """(fold, inner_fold_id, candidate, n_test, score)."""
        if self.algorithm.additive:
            fits = tuning.solve_candidates(self._sums(self.plan_inner), self.names, self.candidates, self._inner_keys)
            if objective in ("mse", "rmse"):
                out = ridge.losses(self._sums(self.plan_inner, "test"), fits, self.names, self._inner_keys, ["candidate"])
                return out.withColumn("score", F.sqrt("mse") if objective == "rmse" else F.col("mse")).drop("mse")
            preds = self._apply(self._inner_roles().filter("split_role = 'test'"), fits, self._inner_keys)
            return tuning.score_predictions(preds, [*self._inner_keys, "candidate"], objective)
        roles, out = self._inner_roles(), []
        for i, c in enumerate(self.candidates):
            preds, _ = models.fit_roles(roles, self.algorithm.name, self.names, self.task.task_type, c, self._inner_keys)
            out.append(tuning.score_predictions(preds.filter("split_role = 'test'"), self._inner_keys, objective).withColumn("candidate", F.lit(i)))
        return reduce(DataFrame.unionByName, out)

    def _chosen(self, fits: DataFrame, best: DataFrame | None) -> DataFrame:
        return fits if best is None else fits.join(best.select(*self.keys, "candidate"), [*self.keys, "candidate"])

    def _groups(self, best: DataFrame | None, roles: DataFrame) -> list[tuple[dict, DataFrame]]:
        """Parameters with the rows of the folds for which they were chosen."""
        if best is None:
            return [(self.candidates[0], roles)]
        chosen = best.select(*self.keys, F.col("candidate").alias("_candidate"))
        both = roles.join(chosen, self.keys)
        used = sorted(r[0] for r in chosen.select("_candidate").distinct().collect())
        return [(self.candidates[i], both.filter(F.col("_candidate") == i).drop("_candidate")) for i in used]

    def inner_best(self, best: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Training rows predicted by inner models, of the chosen candidate, that did not see them; those models."""
        if self.algorithm.additive:
            fits = self._chosen(tuning.solve_candidates(self._sums(self.plan_inner), self.names, self.candidates, self._inner_keys), best)
            preds = self._apply(self._inner_roles().filter("split_role = 'test'"), fits.drop("candidate"), self._inner_keys)
            return preds, ridge.long_coefs(fits, self.names).withColumn("algorithm", F.lit(self.algorithm.name))
        made = [models.fit_roles(rows, self.algorithm.name, self.names, self.task.task_type, c, self._inner_keys) for c, rows in self._groups(best, self._inner_roles())]
        preds, state = (reduce(DataFrame.unionByName, x) for x in zip(*made))
        return preds.filter("split_role = 'test' and pred is not null"), state

    # -- outer folds ---------------------------------------------------------------------

    def outer(self, best: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """Predictions of training and test rows by each fold's model, and the models."""
        if self.algorithm.additive:
            fits = self._chosen(tuning.solve_candidates(self._sums(self._fit_plan()), self.names, self.candidates, self.keys), best)
            state = ridge.long_coefs(fits, self.names).withColumn("algorithm", F.lit(self.algorithm.name))
            return self._apply(self.roles, fits.drop("candidate"), self.keys), state
        made = [models.fit_roles(rows, self.algorithm.name, self.names, self.task.task_type, c, self.keys) for c, rows in self._groups(best, self.roles)]
        return tuple(reduce(DataFrame.unionByName, x) for x in zip(*made))
