"""A meta model on the base model's out-of-fold predictions."""

from common import INNER, OUTER, run

from foldspark.plans.recipes import StackedModelRecipe

result = run(StackedModelRecipe("events", None, OUTER, inner=INNER))
result.load_training_snapshot("meta", 0).show(5)
result.load_predictions("meta", 0, "test").show(5)
