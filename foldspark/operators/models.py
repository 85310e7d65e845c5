"""The model registry, and models fitted for each fold.

Ridge is fitted for all folds at once by sums (:mod:`foldspark.operators.ridge`), logistic
regression by a few rounds of sums (:mod:`foldspark.operators.logistic`), boosted trees by a
round of histograms a level (:mod:`foldspark.operators.boosting`).  The other models go through MLlib, one
distributed fit for each fold.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspark.operators import boosting, logistic
from foldspark.operators.folds import assign
from foldspark.operators.lineage import cut

#: Fits that run at the same time.
PARALLEL = 4


@dataclass(frozen=True)
class Algorithm:
    """How a model is made; ``tasks`` are those it can serve. ``additive`` fits by sums need no estimator.
    ``grouped`` fits all folds at once: (training rows, features, keys, params) to (keys, ..., what ``apply`` needs)."""

    name: str
    tasks: tuple[str, ...]
    make: Callable[[Mapping[str, Any]], Any] | None = None
    additive: bool = False
    grouped: Callable[[DataFrame, Sequence[str], Sequence[str], Mapping[str, Any]], DataFrame] | None = None
    apply: Callable[[Sequence[str]], Column] | None = None
    params: tuple[str, ...] = ()


def _given(params: Mapping[str, Any], **defaults: Any) -> dict[str, Any]:
    return {**defaults, **{k: v for k, v in params.items() if k != "alpha"}}


#: What candidates of models that are fitted by sums may vary.
ADDITIVE_PARAMS = ("alpha", "fit_intercept")


def check_params(algorithm_: Algorithm, names: Sequence[str]) -> None:
    """Refuses parameters that the algorithm does not have."""
    if algorithm_.additive or algorithm_.grouped:
        unknown = [n for n in names if n not in (algorithm_.params or ADDITIVE_PARAMS)]
    else:
        estimator = algorithm_.make({})
        unknown = [n for n in names if not estimator.hasParam(n) and not (n == "alpha" and estimator.hasParam("regParam"))]
    if unknown:
        raise ValueError(f"{algorithm_.name} has no parameter {unknown}")


def _logistic(train: DataFrame, features: Sequence[str], keys: Sequence[str], params: Mapping[str, Any]) -> DataFrame:
    penalty = float(params.get("alpha", params.get("regParam", 0.0)))
    return logistic.fit(train, features, keys, penalty, int(params.get("maxIter", logistic.ROUNDS)), float(params.get("tol", logistic.TOLERANCE)))


REGISTRY: dict[str, Algorithm] = {
    a.name: a
    for a in (
        Algorithm("ridge", ("regression", "classification"), None, True),
        Algorithm("ols", ("regression",), None, True),
        Algorithm("lasso", ("regression",), lambda p: LinearRegression(**_given(p, elasticNetParam=1.0, regParam=float(p.get("alpha", 0.01))))),
        Algorithm("random_forest", ("regression",), lambda p: RandomForestRegressor(**_given(p, seed=1))),
        Algorithm("gbt", ("regression",), grouped=boosting.fit, apply=boosting.score, params=boosting.PARAMS),
        Algorithm("logistic", ("classification",), grouped=_logistic, apply=logistic.probability, params=("alpha", "regParam", "maxIter", "tol")),
        Algorithm("gbt_classifier", ("classification",), grouped=lambda *a: boosting.fit(*a, classes=True), apply=boosting.probability, params=boosting.PARAMS),
    )
}


def algorithm(name: str, task_type: str) -> Algorithm:
    if name not in REGISTRY:
        raise KeyError(f"no algorithm {name}; known: {sorted(REGISTRY)}")
    if task_type not in REGISTRY[name].tasks:
        raise ValueError(f"{name} does not serve {task_type}")
    return REGISTRY[name]


def _vectors(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip").transform(rows.dropna(subset=list(features)))


def fit_roles(roles: DataFrame, name: str, features: Sequence[str], task_type: str, params: Mapping[str, Any] | None = None, keys: Sequence[str] = ("outer_fold_id",)) -> tuple[DataFrame, DataFrame]:
    """(predictions of training and test rows, state) of rows with their role: all folds at once
    where the algorithm can, else one MLlib fit for each fold.

    Folds without training rows have no model and no predictions.  For MLlib vectors are made once;
    ``PARALLEL`` fits run at a time.
    """
    model = algorithm(name, task_type)
    if model.grouped:
        own = ["asset", "bar_ts", "t_idx", "y", "label_end_idx", *(k for k in keys if k != "asset"), "split_role"]
        rows = cut(roles.filter("split_role in ('train', 'test')").dropna(subset=list(features)).select(*own, *features))
        fits = model.grouped(rows.filter("split_role = 'train' and y is not null"), features, list(keys), params or {})
        preds = rows.join(fits, list(keys)).withColumn("pred", model.apply(features)).select(*own, "pred")
        return preds, fits.withColumn("algorithm", F.lit(name))
    make = model.make or (lambda p: LinearRegression(elasticNetParam=0.0, regParam=float(p.get("alpha", 1.0)), standardization=False))
    preds, state = [], []
    vectors = cut(_vectors(roles.filter("split_role in ('train', 'test')"), features).select("asset", "bar_ts", "t_idx", "y", "label_end_idx", *(k for k in keys if k != "asset"), "split_role", "features"))
    trained = (F.col("split_role") == "train") & F.col("y").isNotNull()

    def rows_of(fold) -> DataFrame:
        own = vectors
        for k in keys:
            own = own.filter(F.col(k) == fold[k])
        return own

    def fit(fold):
        train = rows_of(fold).filter(trained).withColumn("label", F.col("y").cast("double"))
        return make(params or {}).fit(train.select("features", "label"))

    # One distributed fit a fold; a plan has few folds.
    every = vectors.filter(trained).select(*keys).distinct().orderBy(*keys).collect()
    with ThreadPoolExecutor(PARALLEL) as pool:
        models_ = list(pool.map(fit, every))
    for fold, fitted in zip(every, models_):
        own = rows_of(fold)
        value = vector_to_array("probability")[1] if task_type == "classification" and model.make else F.col("prediction")
        preds.append(fitted.transform(own).withColumn("pred", value).select("asset", "bar_ts", "t_idx", "y", "label_end_idx", *(k for k in keys if k != "asset"), "split_role", "pred"))
        weights = getattr(fitted, "coefficients", None) or getattr(fitted, "featureImportances", None)
        state.append((*(fold[k] for k in keys), name, float(getattr(fitted, "intercept", 0.0) or 0.0), [float(x) for x in weights.toArray()] if weights is not None else []))
    kinds = ", ".join([*(f"{k} {roles.schema[k].dataType.simpleString()}" for k in keys), "algorithm string, intercept double, coefs array<double>"])
    none = vectors.limit(0).withColumn("pred", F.lit(None).cast("double")).drop("features")
    return reduce(DataFrame.unionByName, preds, none), roles.sparkSession.createDataFrame(state, kinds)


def fit_predict(rows: DataFrame, folds: DataFrame, name: str, features: Sequence[str], task_type: str, params: Mapping[str, Any] | None = None, gap: int = 20) -> tuple[DataFrame, DataFrame]:
    """(predictions of each fold's test rows, state) of rows without a fold."""
    keys = [c for c in ("outer_fold_id", "inner_fold_id") if c in folds.columns]
    preds, state = fit_roles(assign(rows, folds, gap), name, features, task_type, params, keys)
    return preds.filter("split_role = 'test'").drop("split_role"), state


@dataclass(frozen=True)
class HyperoptSpec:
    """Grid (all combinations of ``space``) or random (``samples`` draws with a seed).

    ``objective`` is a loss of ``diagnostics.LOSSES``; the candidate with the smallest mean over inner folds wins.
    """

    method: str = "grid"
    objective: str = "mse"
    space: Mapping[str, Sequence[Any]] = field(default_factory=dict)
    samples: int = 10
    seed: int = 0

    def candidates(self) -> list[dict[str, Any]]:
        """The parameters of each candidate, in order and each once; a candidate's number is its place."""
        out: list[dict[str, Any]] = []
        for c in self._drawn():
            if c not in out:
                out.append(c)
        return out

    def _drawn(self) -> list[dict[str, Any]]:
        import itertools
        import random

        if self.method == "grid":
            return [dict(zip(self.space, v)) for v in itertools.product(*self.space.values())]
        if self.method != "random":
            raise ValueError(f"no search method {self.method}")
        rng = random.Random(self.seed)
        draw = lambda v: 10 ** rng.uniform(v[1], v[2]) if len(v) == 3 and v[0] == "log" else rng.choice(list(v))
        return [{k: draw(v) for k, v in self.space.items()} for _ in range(self.samples)]
