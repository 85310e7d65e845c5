"""Artifacts, their scopes, and frames that know theirs."""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass, field
from enum import Enum

from pyspark.sql import DataFrame

LEVELS = ("global", "outer_fold", "inner_fold")
ROLES = ("full", "train", "test", "oof", "validation")


class ArtifactType(str, Enum):
    """The kinds of artifact; each has key columns that its table begins with."""

    BARS = "BarsArtifact"
    TARGETS = "TargetTableArtifact"
    FEATURES = "FeatureTableArtifact"
    FOLDS = "FoldPlanArtifact"
    PREDICTIONS = "PredictionArtifact"
    DIAGNOSTICS = "DiagnosticArtifact"
    SELECTION = "SelectionArtifact"
    MODEL_STATE = "ModelStateArtifact"
    SNAPSHOT = "TrainingDatasetSnapshotArtifact"
    INNER_PREDICTIONS = "InnerPredictionArtifact"
    INNER_STATE = "InnerModelStateArtifact"


PREFIX: dict[ArtifactType, tuple[str, ...]] = {
    ArtifactType.BARS: ("asset", "bar_ts"),
    ArtifactType.TARGETS: ("asset", "bar_ts", "t_idx", "y", "label_end_idx"),
    ArtifactType.FEATURES: ("asset", "bar_ts"),
    ArtifactType.FOLDS: ("outer_fold_id", "train_start", "train_end", "test_start", "test_end"),
    ArtifactType.PREDICTIONS: ("asset", "bar_ts", "outer_fold_id", "split_role", "y", "pred"),
    ArtifactType.DIAGNOSTICS: ("node", "outer_fold_id", "metric", "value", "known_at"),
    ArtifactType.SELECTION: ("outer_fold_id", "candidate", "weight", "score", "rank", "chosen"),
    ArtifactType.MODEL_STATE: ("outer_fold_id",),
    ArtifactType.SNAPSHOT: ("asset", "bar_ts", "outer_fold_id", "y"),
    ArtifactType.INNER_PREDICTIONS: ("asset", "bar_ts", "outer_fold_id", "inner_fold_id", "y", "pred"),
    ArtifactType.INNER_STATE: ("outer_fold_id", "inner_fold_id"),
}
ROW_LEVEL = {ArtifactType.BARS, ArtifactType.TARGETS, ArtifactType.FEATURES, ArtifactType.PREDICTIONS, ArtifactType.SNAPSHOT, ArtifactType.INNER_PREDICTIONS}


@dataclass(frozen=True)
class ArtifactScope:
    """Which part of validation an artifact belongs to."""

    cv_level: str = "global"
    split_role: str = "full"
    outer_fold_id: int | None = None
    inner_fold_id: int | None = None

    def __post_init__(self) -> None:
        if self.cv_level not in LEVELS or self.split_role not in ROLES:
            raise ValueError(f"no such scope: {self.cv_level}, {self.split_role}")
        if (self.cv_level == "global") != (self.outer_fold_id is None) or (self.cv_level == "inner_fold") != (self.inner_fold_id is not None):
            raise ValueError(f"fold ids don't fit the level {self.cv_level}")


@dataclass(frozen=True)
class ArtifactRef:
    """Where an artifact is, what it is and what it was made from."""

    artifact_id: str
    artifact_type: str
    node_name: str
    path: str
    scope: ArtifactScope
    schema: str
    metadata: dict[str, str] = field(default_factory=dict)
    upstream_ids: tuple[str, ...] = ()

    def row(self) -> dict:
        return asdict(self) | {"upstream_ids": list(self.upstream_ids)}


INDEX_SCHEMA = (
    "artifact_id string, artifact_type string, node_name string, path string, scope struct<cv_level:string,split_role:string,outer_fold_id:int,inner_fold_id:int>, "
    "schema string, metadata map<string,string>, upstream_ids array<string>"
)


def artifact_id(graph_hash: str, node: str, kind: str, scope: ArtifactScope) -> str:
    """The same for the same graph, so that runs can be compared."""
    return hashlib.sha256("|".join([graph_hash, node, kind, repr(scope)]).encode()).hexdigest()[:20]


class GranularityError(ValueError):
    """Fold-level values would meet rows without a projection."""


@dataclass(frozen=True)
class ScopedFrame:
    """A DataFrame with its artifact type."""

    df: DataFrame
    kind: ArtifactType

    @property
    def row_level(self) -> bool:
        return self.kind in ROW_LEVEL

    @property
    def keys(self) -> list[str]:
        rows = ["asset", "bar_ts"] if self.row_level else []
        return [*rows, *(c for c in ("outer_fold_id", "inner_fold_id") if c in self.df.columns)]

    def check(self) -> "ScopedFrame":
        missing = [c for c in PREFIX[self.kind] if c not in self.df.columns]
        if missing:
            raise ValueError(f"{self.kind.value} lacks {missing}")
        return self


def join_scoped(left: ScopedFrame, right: ScopedFrame, how: str = "inner") -> ScopedFrame:
    """Joins on all keys that both have; a fold-level table cannot meet rows here."""
    if left.row_level != right.row_level:
        raise GranularityError(f"{left.kind.value} and {right.kind.value} differ in granularity: use a ProjectionNode")
    on = [k for k in left.keys if k in right.keys]
    return ScopedFrame(left.df.join(right.df, on, how), left.kind)
