"""Candidates on different inputs, chosen by recent performance, and blended."""

from common import OUTER, run

from foldspark.plans.recipes import SelectorRecipe

for strategy in ("best_recent", "weighted_blend", "diagnostic_aware", "regime_conditioned"):
    result = run(SelectorRecipe("events", None, OUTER, strategy=strategy))
    result.load_artifact("selected", artifact_type="SelectionArtifact").orderBy("outer_fold_id", "rank").show()
