"""The workflow graph: checked, ordered, written as JSON."""

from __future__ import annotations

import dataclasses
import hashlib
import json
from dataclasses import dataclass, field
from typing import Any

from foldspark.operators.folds import ValidationSpec
from foldspark.operators.models import HyperoptSpec, algorithm
from foldspark.plans import specs
from foldspark.plans.artifacts import ArtifactType, GranularityError
from foldspark.plans.nodes import KINDS, ModelNode, Node

_PARTS = {k.__name__: k for k in (specs.ModelSpec, specs.TrainingRecipe, specs.ModelInputs, specs.DiagnosticInputs, specs.DerivedInputs, specs.ProjectionInputs, specs.SelectionInputs, ValidationSpec, HyperoptSpec)} | KINDS


class GraphError(ValueError):
    """A graph that cannot run."""


def plain(x: Any) -> Any:
    if dataclasses.is_dataclass(x):
        return {"_": type(x).__name__} | {f.name: plain(getattr(x, f.name)) for f in dataclasses.fields(x)}
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def _typed(x: Any) -> Any:
    if isinstance(x, dict) and "_" in x:
        cls = _PARTS[x["_"]]
        given = {k: _typed(v) for k, v in x.items() if k != "_"}
        tuples = {f.name for f in dataclasses.fields(cls) if "tuple" in str(f.type)}
        return cls(**{k: tuple(v) if k in tuples and isinstance(v, list) else v for k, v in given.items()})
    if isinstance(x, dict):
        return {k: _typed(v) for k, v in x.items()}
    return [_typed(v) for v in x] if isinstance(x, list) else x


@dataclass(frozen=True)
class WorkflowGraph:
    nodes: tuple[Node, ...]
    #: What it was compiled from, for the run's config.
    origin: dict | None = field(default=None, compare=False)

    def node(self, name: str) -> Node:
        return next(n for n in self.nodes if n.name == name)

    def order(self) -> list[Node]:
        """Nodes after all they read; raises where there is no such order."""
        left, out = {n.name: n for n in self.nodes}, []
        while left:
            ready = [n for n in left.values() if not any(x in left for x, _ in n.needs())]
            if not ready:
                raise GraphError(f"a cycle among {sorted(left)}")
            for n in ready:
                out.append(left.pop(n.name))
        return out

    def validate(self) -> "WorkflowGraph":
        names = [n.name for n in self.nodes]
        if len(set(names)) < len(names):
            raise GraphError("two nodes have one name")
        for node in self.nodes:
            for name, kind in node.needs():
                if name not in names:
                    raise GraphError(f"{node.name} reads {name}, which is no node")
                if kind not in self.node(name).gives:
                    raise GraphError(f"{node.name} reads {kind.value} of {name}, which gives {[g.value for g in self.node(name).gives]}")
            if isinstance(node, ModelNode):
                if node.inputs.diagnostic_tables:
                    raise GranularityError(f"{node.name} reads fold-level {node.inputs.diagnostic_tables}: put a ProjectionNode between")
                if len(node.inputs.target_tables) != 1 or not node.inputs.fold_plans:
                    raise GraphError(f"{node.name} needs one target table and a fold plan")
                for up in node.inputs.prediction_tables:
                    other = self.node(up)
                    if isinstance(other, ModelNode) and not other.training.generate_train_oof_predictions:
                        raise GraphError(f"{node.name} would train on in-sample predictions of {up}: let that generate out-of-fold predictions")
                for name in node.inputs.selection_tables:
                    for up in self.node(name).inputs.prediction_tables:
                        if not getattr(getattr(self.node(up), "training", None), "generate_train_oof_predictions", False):
                            raise GraphError(f"{node.name} trains on what {name} selects, so {up} must generate out-of-fold predictions")
        self.order()
        return self

    def check_tasks(self, tasks: Any) -> None:
        """Each model's algorithm must serve its task."""
        for node in self.nodes:
            if isinstance(node, ModelNode):
                algorithm(node.model.algorithm, tasks.get(node.task_name).task_type)

    def to_json(self) -> str:
        return json.dumps([plain(n) for n in self.nodes], indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "WorkflowGraph":
        return WorkflowGraph(tuple(_typed(n) for n in json.loads(text)))

    def hash(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:16]


def gives(node: Node, kind: ArtifactType) -> bool:
    return kind in node.gives
