"""What models are and how they are trained; the typed inputs of nodes."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from foldspark.operators.folds import ValidationSpec
from foldspark.operators.models import HyperoptSpec

__all__ = ["DerivedInputs", "DiagnosticInputs", "HyperoptSpec", "ModelInputs", "ModelSpec", "ProjectionInputs", "SelectionInputs", "TrainingRecipe", "ValidationSpec"]


@dataclass(frozen=True)
class ModelSpec:
    """An estimator; the registry says which tasks its algorithm serves."""

    name: str
    algorithm: str = "ridge"
    params: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class TrainingRecipe:
    """How an estimator is trained in each outer fold.

    Without ``refit_on_full_outer_train`` a fold is served by the model of its last inner fold.
    """

    selection_validation: ValidationSpec | None = None
    hyperopt: HyperoptSpec | None = None
    refit_on_full_outer_train: bool = True
    generate_train_oof_predictions: bool = False
    save_training_snapshot: bool = False
    calibration: str | None = None

    def __post_init__(self) -> None:
        if (self.hyperopt or self.generate_train_oof_predictions or self.calibration) and self.selection_validation is None:
            raise ValueError("tuning, out-of-fold predictions and calibration need selection_validation")
        if not self.refit_on_full_outer_train and self.selection_validation is None:
            raise ValueError("without a refit the last inner model serves, which needs selection_validation")
        if self.calibration not in (None, "isotonic", "platt"):
            raise ValueError(f"no calibration {self.calibration}")


@dataclass(frozen=True)
class ModelInputs:
    """Names of the nodes a model reads, by what they give."""

    bars: list[str] = field(default_factory=list)
    fold_plans: list[str] = field(default_factory=list)
    feature_tables: list[str] = field(default_factory=list)
    target_tables: list[str] = field(default_factory=list)
    prediction_tables: list[str] = field(default_factory=list)
    diagnostic_tables: list[str] = field(default_factory=list)
    selection_tables: list[str] = field(default_factory=list)
    use_base_features: bool = True


@dataclass(frozen=True)
class DiagnosticInputs:
    prediction_tables: list[str] = field(default_factory=list)
    feature_tables: list[str] = field(default_factory=list)
    target_tables: list[str] = field(default_factory=list)
    fold_plans: list[str] = field(default_factory=list)
    model_states: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class DerivedInputs:
    prediction_tables: list[str] = field(default_factory=list)
    horizon: int = 20


@dataclass(frozen=True)
class ProjectionInputs:
    bars: list[str] = field(default_factory=list)
    diagnostic_tables: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class SelectionInputs:
    prediction_tables: list[str] = field(default_factory=list)
    fold_plans: list[str] = field(default_factory=list)
    diagnostic_tables: list[str] = field(default_factory=list)
    regime_tables: list[str] = field(default_factory=list)
