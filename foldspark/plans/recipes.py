"""Recipes: what researchers write. Each compiles to a workflow graph."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from foldspark.operators.folds import ValidationSpec
from foldspark.plans.graph import WorkflowGraph, plain
from foldspark.plans.nodes import DataNode, DiagnosticNode, FeatureNode, FoldPlanNode, ModelNode, Node, ProjectionNode, SelectionNode, TargetNode
from foldspark.plans.specs import DiagnosticInputs, HyperoptSpec, ModelInputs, ModelSpec, ProjectionInputs, SelectionInputs, TrainingRecipe

Features = tuple[str, Mapping[str, Any]]


@dataclass(frozen=True)
class Recipe:
    """Data, validation and the outer plan that all recipes share."""

    source: str
    assets: tuple[str, ...] | None = None
    validation: ValidationSpec = field(default_factory=ValidationSpec)
    gap: int = 0

    def _base(self, tasks: list[str], features: list[Features]) -> list[Node]:
        return [
            DataNode("bars", self.source, self.assets),
            FoldPlanNode("folds", "bars", self.validation, gap=self.gap),
            *(TargetNode(f"target_{t}", "bars", t) for t in dict.fromkeys(tasks)),
            *(FeatureNode(f"features_{n}", "bars", n, p) for n, p in features),
        ]

    @staticmethod
    def _model(name: str, task: str, features: list[str], model: ModelSpec, training: TrainingRecipe, columns: tuple[str, ...] = (), predictions: list[str] | None = None) -> ModelNode:
        inputs = ModelInputs(bars=["bars"], fold_plans=["folds"], feature_tables=features, target_tables=[f"target_{task}"], prediction_tables=predictions or [])
        return ModelNode(name, inputs, model, training, task, columns)

    def nodes(self) -> list[Node]:
        raise NotImplementedError

    def compile(self) -> WorkflowGraph:
        return WorkflowGraph(tuple(self.nodes()), plain(self)).validate()


@dataclass(frozen=True)
class SingleModelRecipe(Recipe):
    task: str = "ret20"
    features: Features = ("baseline", {})
    model: ModelSpec = field(default_factory=lambda: ModelSpec("model"))
    training: TrainingRecipe = field(default_factory=TrainingRecipe)
    columns: tuple[str, ...] = ()

    def nodes(self) -> list[Node]:
        name, params = self.features
        model = self._model(self.model.name, self.task, [f"features_{name}"], self.model, self.training, self.columns)
        return [*self._base([self.task], [(name, params)]), model, DiagnosticNode("metrics", "metrics", DiagnosticInputs(prediction_tables=[self.model.name]))]


@dataclass(frozen=True)
class FeatureComparisonRecipe(Recipe):
    """One model for each feature set; ``sets`` maps a name to families."""

    task: str = "ret20"
    sets: Mapping[str, list[Features]] = field(default_factory=dict)
    model: ModelSpec = field(default_factory=lambda: ModelSpec("model"))

    def nodes(self) -> list[Node]:
        families = {n: p for fs in self.sets.values() for n, p in fs}
        out = self._base([self.task], list(families.items()))
        for name, fs in self.sets.items():
            out.append(self._model(f"model_{name}", self.task, [f"features_{n}" for n, _ in fs], self.model, TrainingRecipe()))
            out.append(DiagnosticNode(f"metrics_{name}", "metrics", DiagnosticInputs(prediction_tables=[f"model_{name}"])))
        return out


@dataclass(frozen=True)
class NestedTuningRecipe(Recipe):
    task: str = "ret20"
    features: Features = ("baseline", {})
    model: ModelSpec = field(default_factory=lambda: ModelSpec("model"))
    inner: ValidationSpec = field(default_factory=lambda: ValidationSpec(min_train_size=120, test_size=50))
    hyperopt: HyperoptSpec = field(default_factory=lambda: HyperoptSpec(space={"alpha": [0.01, 1.0, 100.0]}))
    columns: tuple[str, ...] = ()

    def nodes(self) -> list[Node]:
        name, params = self.features
        training = TrainingRecipe(self.inner, self.hyperopt, save_training_snapshot=True)
        return [
            *self._base([self.task], [(name, params)]),
            FoldPlanNode("inner_folds", "bars", self.inner, "inner", "folds", self.gap),
            self._model(self.model.name, self.task, [f"features_{name}"], self.model, training, self.columns),
            DiagnosticNode("metrics", "metrics", DiagnosticInputs(prediction_tables=[self.model.name])),
        ]


@dataclass(frozen=True)
class StackedModelRecipe(Recipe):
    """Base models, and a meta model on their out-of-fold predictions."""

    tasks: tuple[str, ...] = ("ret20",)
    meta_task: str = "ret20"
    features: Features = ("baseline", {})
    columns: tuple[str, ...] = ("ret5", "vol20")
    inner: ValidationSpec = field(default_factory=lambda: ValidationSpec(min_train_size=120, test_size=50))
    base_features_in_meta: bool = False

    def _bases(self) -> list[Node]:
        training = TrainingRecipe(self.inner, generate_train_oof_predictions=True)
        return [self._model(f"{t}_model", t, [f"features_{self.features[0]}"], ModelSpec(f"{t}_model"), training, self.columns) for t in self.tasks]

    def nodes(self) -> list[Node]:
        bases = self._bases()
        meta_features = [f"features_{self.features[0]}"] if self.base_features_in_meta else []
        preds = [n.name for n in bases]
        columns = (*self.columns, *(f"pred_{p}" for p in preds))
        meta = self._model("meta", self.meta_task, meta_features, ModelSpec("meta"), TrainingRecipe(save_training_snapshot=True), columns, preds)
        return [*self._base([*self.tasks, self.meta_task], [self.features]), *bases, meta, DiagnosticNode("metrics", "metrics", DiagnosticInputs(prediction_tables=["meta"]))]


@dataclass(frozen=True)
class DiagnosticAwareMetaRecipe(StackedModelRecipe):
    """A meta model of another target that also sees lagged health of the base models."""

    tasks: tuple[str, ...] = ("ret20", "vol20")
    meta_task: str = "ret40"
    base_features_in_meta: bool = True
    drift_columns: tuple[str, ...] = ("ret5", "vol20")

    def nodes(self) -> list[Node]:
        bases = self._bases()
        preds, table = [n.name for n in bases], f"features_{self.features[0]}"
        checks: list[Node] = [DiagnosticNode("drift", "feature_drift", DiagnosticInputs(feature_tables=[table], target_tables=[f"target_{self.tasks[0]}"], fold_plans=["folds"]), self.drift_columns)]
        for p in preds:
            checks.append(DiagnosticNode(f"gap_{p}", "train_test_deviance_gap", DiagnosticInputs(prediction_tables=[p])))
            checks.append(DiagnosticNode(f"resid_{p}", "residual_std_by_asset", DiagnosticInputs(prediction_tables=[p])))
        health = ProjectionNode("health", ProjectionInputs(["bars"], [c.name for c in checks]))
        meta = self._model("meta", self.meta_task, [table, "health"], ModelSpec("meta"), TrainingRecipe(save_training_snapshot=True), self._meta_columns(preds, checks), preds)
        metrics = DiagnosticNode("metrics", "metrics", DiagnosticInputs(prediction_tables=["meta"]))
        return [*self._base([*self.tasks, self.meta_task], [self.features]), *bases, *checks, health, meta, metrics]

    def _meta_columns(self, preds: list[str], checks: list[Node]) -> tuple[str, ...]:
        drift = [f"drift_psi_{c}" for c in self.drift_columns] + [f"drift_mean_shift_{c}" for c in self.drift_columns]
        health = [f"{c.name}_{c.kind}" for c in checks if isinstance(c, DiagnosticNode) and c.kind != "feature_drift"]
        return (*self.columns, *(f"pred_{p}" for p in preds), *drift, *health, "drift_known")


@dataclass(frozen=True)
class SelectorRecipe(Recipe):
    """Candidates on different inputs, and a choice by recent performance; ``candidates`` maps a name to columns."""

    task: str = "ret20"
    features: Features = ("baseline", {})
    candidates: Mapping[str, tuple[str, ...]] = field(default_factory=lambda: {"a": ("ret5", "vol20"), "b": ("ret1", "mom20")})
    strategy: str = "best_recent"
    recent_folds: int = 2
    metric: str = "mse"

    def nodes(self) -> list[Node]:
        table = f"features_{self.features[0]}"
        made = [self._model(n, self.task, [table], ModelSpec(n), TrainingRecipe(), c) for n, c in self.candidates.items()]
        gaps = [DiagnosticNode(f"gap_{m.name}", "train_test_deviance_gap", DiagnosticInputs(prediction_tables=[m.name])) for m in made] if self.strategy == "diagnostic_aware" else []
        regime = [FeatureNode("features_regime", "bars", "regime", {})] if self.strategy == "regime_conditioned" else []
        inputs = SelectionInputs([m.name for m in made], ["folds"], [g.name for g in gaps], [r.name for r in regime])
        choose = SelectionNode("selected", self.strategy, inputs, self.recent_folds, self.metric)
        return [*self._base([self.task], [self.features]), *regime, *made, *gaps, choose, DiagnosticNode("metrics", "metrics", DiagnosticInputs(prediction_tables=["selected"]))]


def required_workflow(source: str, **kw: Any) -> WorkflowGraph:
    """Return 40 from baseline features, predictions of return 20 and volatility 20, and the lagged health of both."""
    return DiagnosticAwareMetaRecipe(source, **kw).compile()
