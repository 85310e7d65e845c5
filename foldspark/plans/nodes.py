"""The ten typed nodes. Each names its inputs by kind and says what it gives."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any, ClassVar

from foldspark.operators.folds import ValidationSpec
from foldspark.plans.artifacts import ArtifactType as A
from foldspark.plans.specs import DerivedInputs, DiagnosticInputs, ModelInputs, ModelSpec, ProjectionInputs, SelectionInputs, TrainingRecipe


@dataclass(frozen=True)
class Node:
    name: str
    gives: ClassVar[tuple[A, ...]] = ()

    def needs(self) -> list[tuple[str, A]]:
        """Names of the nodes it reads, and what it reads of each."""
        return []


@dataclass(frozen=True)
class DataNode(Node):
    source: str = ""
    assets: tuple[str, ...] | None = None
    gives: ClassVar = (A.BARS,)


@dataclass(frozen=True)
class TargetNode(Node):
    bars: str = ""
    task_name: str = ""
    gives: ClassVar = (A.TARGETS,)

    def needs(self) -> list[tuple[str, A]]:
        return [(self.bars, A.BARS)]


@dataclass(frozen=True)
class FoldPlanNode(Node):
    bars: str = ""
    validation: ValidationSpec = field(default_factory=ValidationSpec)
    level: str = "outer"
    outer: str | None = None
    gap: int = 0
    gives: ClassVar = (A.FOLDS,)

    def needs(self) -> list[tuple[str, A]]:
        return [(self.bars, A.BARS)] if self.level == "outer" else [(self.bars, A.BARS), (str(self.outer), A.FOLDS)]


@dataclass(frozen=True)
class FeatureNode(Node):
    """Stateless causal features of one family."""

    bars: str = ""
    family: str = "baseline"
    params: Mapping[str, Any] = field(default_factory=dict)
    gives: ClassVar = (A.FEATURES,)

    def needs(self) -> list[tuple[str, A]]:
        return [(self.bars, A.BARS)]


@dataclass(frozen=True)
class TransformNode(Node):
    """A transform fitted on each fold's training rows: scale, clip, pca or select."""

    features: str = ""
    targets: str = ""
    folds: str = ""
    kind: str = "scale"
    columns: tuple[str, ...] = ()
    params: Mapping[str, Any] = field(default_factory=dict)
    gives: ClassVar = (A.FEATURES,)

    def needs(self) -> list[tuple[str, A]]:
        return [(self.features, A.FEATURES), (self.targets, A.TARGETS), (self.folds, A.FOLDS)]


@dataclass(frozen=True)
class ModelNode(Node):
    inputs: ModelInputs = field(default_factory=ModelInputs)
    model: ModelSpec = field(default_factory=lambda: ModelSpec("ridge"))
    training: TrainingRecipe = field(default_factory=TrainingRecipe)
    task_name: str = ""
    columns: tuple[str, ...] = ()
    gives: ClassVar = (A.PREDICTIONS, A.MODEL_STATE, A.DIAGNOSTICS, A.SNAPSHOT, A.INNER_PREDICTIONS, A.INNER_STATE)

    def needs(self) -> list[tuple[str, A]]:
        i = self.inputs
        kinds = ((i.bars, A.BARS), (i.fold_plans, A.FOLDS), (i.feature_tables, A.FEATURES), (i.target_tables, A.TARGETS), (i.prediction_tables, A.PREDICTIONS), (i.selection_tables, A.SELECTION))
        return [(n, k) for names, k in kinds for n in names] + [(n, A.DIAGNOSTICS) for n in i.diagnostic_tables]


@dataclass(frozen=True)
class DiagnosticNode(Node):
    kind: str = "train_test_deviance_gap"
    inputs: DiagnosticInputs = field(default_factory=DiagnosticInputs)
    columns: tuple[str, ...] = ()
    task_type: str = "regression"
    gives: ClassVar = (A.DIAGNOSTICS,)

    def needs(self) -> list[tuple[str, A]]:
        i = self.inputs
        kinds = ((i.prediction_tables, A.PREDICTIONS), (i.feature_tables, A.FEATURES), (i.target_tables, A.TARGETS), (i.fold_plans, A.FOLDS), (i.model_states, A.MODEL_STATE))
        return [(n, k) for names, k in kinds for n in names]


@dataclass(frozen=True)
class DerivedFeatureNode(Node):
    """Row-level features from predictions: residual_std, model_health or disagreement."""

    kind: str = "residual_std"
    inputs: DerivedInputs = field(default_factory=DerivedInputs)
    gives: ClassVar = (A.FEATURES,)

    def needs(self) -> list[tuple[str, A]]:
        return [(n, A.PREDICTIONS) for n in self.inputs.prediction_tables]


@dataclass(frozen=True)
class ProjectionNode(Node):
    """The only way from fold-level diagnostics to rows."""

    inputs: ProjectionInputs = field(default_factory=ProjectionInputs)
    lag_folds: int = 0
    gives: ClassVar = (A.FEATURES,)

    def needs(self) -> list[tuple[str, A]]:
        return [(n, A.BARS) for n in self.inputs.bars] + [(n, A.DIAGNOSTICS) for n in self.inputs.diagnostic_tables]


@dataclass(frozen=True)
class SelectionNode(Node):
    """best_recent, weighted_blend, diagnostic_aware or regime_conditioned."""

    strategy: str = "best_recent"
    inputs: SelectionInputs = field(default_factory=SelectionInputs)
    recent_folds: int = 2
    #: A loss of ``diagnostics.LOSSES``, by which candidates are scored.
    metric: str = "mse"
    gives: ClassVar = (A.SELECTION, A.PREDICTIONS)

    def needs(self) -> list[tuple[str, A]]:
        i = self.inputs
        kinds = ((i.prediction_tables, A.PREDICTIONS), (i.fold_plans, A.FOLDS), (i.diagnostic_tables, A.DIAGNOSTICS), (i.regime_tables, A.FEATURES))
        return [(n, k) for names, k in kinds for n in names]


KINDS = {k.__name__: k for k in (DataNode, TargetNode, FoldPlanNode, FeatureNode, TransformNode, ModelNode, DiagnosticNode, DerivedFeatureNode, ProjectionNode, SelectionNode)}
