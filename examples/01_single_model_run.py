"""The simplest run: one asset, baseline features, one target, ridge, expanding folds."""

from common import OUTER, run

from foldspark.plans.recipes import SingleModelRecipe

result = run(SingleModelRecipe("events", ("click",), OUTER, columns=("ret5", "vol20")))
print(result.list_nodes())
result.load_artifact("metrics").orderBy("outer_fold_id", "metric").show()
