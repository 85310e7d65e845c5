"""Penalties of ridge chosen on inner expanding folds, judged on the outer tests."""

from common import INNER, OUTER, run

from foldspark.plans.recipes import NestedTuningRecipe

result = run(NestedTuningRecipe("events", None, OUTER, inner=INNER, columns=("ret5", "vol20")))
result.load_inner_validation("model", 0).orderBy("inner_fold_id", "alpha").show()
result.load_artifact("metrics").filter("metric = 'rmse'").show()
