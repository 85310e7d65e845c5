"""Baseline, an outside field package (a stand-in here) and both, compared fold by fold."""

from common import OUTER, runner
from pyspark.sql import functions as F

from foldspark.functions.features import FieldAdapter
from foldspark.operators import analysis
from foldspark.plans.inspect import load_run
from foldspark.plans.recipes import FeatureComparisonRecipe

r = runner()
r.features.register(FieldAdapter(lambda bars, p: bars.select("asset", "bar_ts", (F.col("high") - F.col("low")).alias("field_spread"))))
sets = {"baseline": [("baseline", {})], "field": [("field_adapter", {})], "combined": [("baseline", {}), ("field_adapter", {})]}
result = load_run(r.spark, r.root, r.run(FeatureComparisonRecipe("events", None, OUTER, sets=sets).compile()))
runs = {n: result.load_predictions(f"model_{n}", split_role="test") for n in sets}
analysis.compare(runs, "baseline").orderBy("outer_fold_id", "candidate").show()
