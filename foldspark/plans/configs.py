"""Runs from configuration files: JSON that names a recipe and its fields.

```json
{"recipe": "NestedTuningRecipe", "source": "events", "columns": ["ret5", "vol20"],
 "validation": {"min_train_size": 300, "test_size": 100, "embargo": 20},
 "hyperopt": {"method": "grid", "objective": "mse", "space": {"alpha": [0.01, 1.0, 100.0]}}}
```

Fields are those of the recipe; what is left out has the recipe's default.  Unknown names are refused.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession

from foldspark.operators.folds import ValidationSpec
from foldspark.operators.models import HyperoptSpec
from foldspark.plans import recipes
from foldspark.plans.specs import ModelSpec, TrainingRecipe
from foldspark.sources import files

RECIPES = {r.__name__: r for r in (recipes.SingleModelRecipe, recipes.FeatureComparisonRecipe, recipes.NestedTuningRecipe, recipes.StackedModelRecipe, recipes.DiagnosticAwareMetaRecipe, recipes.SelectorRecipe)}
_PARTS = {"validation": ValidationSpec, "inner": ValidationSpec, "selection_validation": ValidationSpec, "hyperopt": HyperoptSpec, "model": ModelSpec, "training": TrainingRecipe}


def _made(kind: type, told: Mapping[str, Any]) -> Any:
    known = {f.name for f in fields(kind)}
    if unknown := sorted(set(told) - known):
        raise ValueError(f"{kind.__name__} has no {unknown}; it has {sorted(known)}")
    return kind(**{k: _value(k, v) for k, v in told.items()})


def _value(name: str, value: Any) -> Any:
    if name in _PARTS and isinstance(value, Mapping):
        return _made(_PARTS[name], value)
    if name == "features":
        return (value[0], value[1])
    if name == "sets":
        return {k: [(f, p) for f, p in v] for k, v in value.items()}
    if name == "candidates":
        return {k: tuple(v) for k, v in value.items()}
    return tuple(value) if isinstance(value, list) else value


def recipe_of(config: Mapping[str, Any]) -> recipes.Recipe:
    """The recipe that a configuration describes."""
    name = config.get("recipe")
    if name not in RECIPES:
        raise ValueError(f"no recipe {name}; known: {sorted(RECIPES)}")
    return _made(RECIPES[name], {k: v for k, v in config.items() if k != "recipe"})


def read(spark: SparkSession, path: str) -> recipes.Recipe:
    return recipe_of(json.loads(files.read_text(spark, path)))
