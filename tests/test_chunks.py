import numpy as np
import pandas as pd
import pytest
from helpers import START
from pyspark.sql import functions as F

from foldspark.functions import features as feat
from foldspark.functions.targets import default_tasks
from foldspark.operators import analysis, chunks
from foldspark.sources.bars import event_bars, with_time_index

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def panel(spark):
    """Event bars, and an asset with long gaps between bursts of a few bars."""
    bars = event_bars(spark, SF)
    rng = np.random.default_rng(4)
    hours = np.unique(np.concatenate([start + rng.integers(0, 9, 5) for start in range(0, 6000, 150)]))
    gaps = pd.DataFrame({"asset": "gaps", "bar_ts": [START + pd.Timedelta(hours=int(h)) for h in hours], "close": 100 + rng.normal(0, 1, len(hours)).cumsum()})
    for c in ("open", "high", "low"):
        gaps[c] = gaps.close + {"open": 0.1, "high": 1.0, "low": -1.0}[c]
    gaps["volume"], gaps["n_trades"] = 1.0, 1
    more = spark.createDataFrame(gaps).select(*(F.col(c).cast(t) for c, t in bars.dtypes))
    return with_time_index(bars.unionByName(more)).cache()


def told(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("rows", [15, 150])
def test_features_in_chunks_are_those_of_whole_series(panel, rows):
    for family in (feat.Baseline(), feat.Regime()):
        make = lambda b, f=family: f.apply(b, {})
        made = chunks.in_chunks(panel, make, family.memory({}), rows=rows)
        assert made.columns == make(panel).columns and told(made) == told(make(panel))


def test_targets_in_chunks_are_those_of_whole_series(panel):
    tasks = default_tasks()
    for name in ("ret20", "vol20", "updown20"):
        task = tasks.get(name)
        assert told(chunks.in_chunks(panel, task.table, 1, task.horizon, 33)) == told(task.table(panel))


def test_a_run_in_chunks_is_the_same(spark, tmp_path):
    from foldspark.operators.folds import ValidationSpec
    from foldspark.plans.inspect import load_run
    from foldspark.plans.recipes import SingleModelRecipe
    from foldspark.plans.runner import Runner
    from foldspark.sources.vendors import TableVendor

    recipe = SingleModelRecipe("events", None, ValidationSpec(min_train_size=200, test_size=120, embargo=20), columns=("ret5", "vol20"))
    out = []
    for k, rows in enumerate((None, 40)):
        runner = Runner(spark, str(tmp_path / str(k)), {"events": TableVendor(lambda s: event_bars(s, SF))}, chunk_rows=rows)
        out.append(told(load_run(spark, runner.root, runner.run(recipe.compile())).load_predictions("model").select("asset", "bar_ts", "outer_fold_id", "split_role", F.round("pred", 9))))
    assert out[0] and out[0] == out[1]


@pytest.mark.parametrize("assets, times", [(64, 512), (2, 24)])
def test_correlations_of_blocks_are_those_of_pairs(spark, monkeypatch, assets, times):
    rng = np.random.default_rng(3)
    rows = [(f"x{a}", START + pd.Timedelta(hours=t), float(100 + rng.normal())) for a in range(7) for t in range(120) if rng.random() < 0.8] + [("lone", START, 5.0), ("lone", START + pd.Timedelta(hours=1), 6.0)]
    bars = spark.createDataFrame(rows, "asset string, bar_ts timestamp_ntz, close double")
    d = feat.with_returns(bars).toPandas().pivot(index="bar_ts", columns="asset", values="ret1")
    got = {}
    source = analysis.asset_correlations.__globals__
    monkeypatch.setitem(source, "TIMES", times)
    if assets == 64:
        got = {(r.asset, r.other): r for r in analysis.asset_correlations(bars).collect()}
        for a in d:
            for b in d:
                both = d[[a, b]].dropna() if a < b else []
                if len(both):
                    assert got[a, b].n == len(both) and (got[a, b].corr is None if len(both) < 3 else got[a, b].corr == pytest.approx(both[a].corr(both[b]), abs=1e-9))
        assert len(got) == sum(a < b and len(d[[a, b]].dropna()) > 0 for a in d for b in d)
    else:
        # More assets than a block has, by the columns of a wide panel.
        wide = [(f"y{a:03d}", START + pd.Timedelta(hours=t), float(100 + rng.normal())) for a in range(70) for t in range(30)]
        bars = spark.createDataFrame(wide, "asset string, bar_ts timestamp_ntz, close double")
        d = feat.with_returns(bars).toPandas().pivot(index="bar_ts", columns="asset", values="ret1").corr()
        got = {(r.asset, r.other): r.corr for r in analysis.asset_correlations(bars).collect()}
        assert len(got) == 70 * 69 // 2 and all(v == pytest.approx(d.loc[a, b], abs=1e-9) for (a, b), v in got.items())
