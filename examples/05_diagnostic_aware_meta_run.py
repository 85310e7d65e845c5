"""The required workflow: return 40 from features, predictions of return 20 and volatility 20, and their lagged health."""

from common import INNER, OUTER, runner

from foldspark.plans.inspect import load_run
from foldspark.plans.recipes import required_workflow

r = runner()
result = load_run(r.spark, r.root, r.run(required_workflow("events", validation=OUTER, inner=INNER)))
for depth, node, kind, fold in result.show_lineage("meta", 0):
    print("  " * depth, node, kind, fold)
result.load_artifact("health").orderBy("bar_ts", ascending=False).show(3)
result.load_artifact("metrics").filter("metric in ('rmse', 'ic')").show()
