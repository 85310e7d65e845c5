import pytest
from helpers import START, bars, linear
from pyspark.sql import functions as F

from foldspark.functions import features, targets
from foldspark.operators import leakage
from foldspark.sources import bars as src


def test_forward_return_of_linear_bars(spark):
    rows = targets.PredictionTask("r", "regression", 5, targets.forward_return).table(linear(spark)).filter("asset = 'a'").collect()
    for r in rows:
        if r["t_idx"] + 5 < 60:
            assert r["y"] == pytest.approx(5 / (100 + r["t_idx"])) and r["label_end_idx"] == r["t_idx"] + 5
        else:
            assert r["y"] is None and r["label_end_idx"] is None


def test_label_ends_later_where_bars_are_missing(spark):
    made = bars(spark, {"a": {t: 100.0 + t for t in range(60)}, "b": {t: 100.0 + t for t in range(60) if not 20 <= t < 25}})
    rows = targets.PredictionTask("r", "regression", 5, targets.forward_return).table(made)
    late = rows.filter("asset = 'b' and label_end_idx > t_idx + 5").count()
    assert late == 5 and rows.filter("asset = 'a' and label_end_idx <> t_idx + 5").count() == 0


def test_flat_and_zero_bars_give_null_or_zero_never_an_error(spark):
    flat = bars(spark, {"a": {t: 5.0 for t in range(40)}, "b": {t: 0.0 if t == 10 else 5.0 for t in range(40)}})
    rows = features.Baseline().apply(flat, {}).collect()
    assert {r["ret1"] for r in rows if r["asset"] == "a"} == {None, 0.0}
    assert [r["ret1"] for r in rows if r["asset"] == "b" and r["bar_ts"].hour == 11][0] is None
    features.CrossAsset().apply(flat, {}).collect()
    features.Regime().apply(flat, {"past": 10}).collect()


@pytest.mark.parametrize("family", [features.Baseline(), features.CrossAsset(), features.Regime()])
def test_families_are_causal(spark, family):
    made = bars(spark, {a: {t: 100.0 + (t * 7 + k) % 13 for t in range(90)} for k, a in enumerate("abc")})
    leakage.causal(made, lambda b: family.apply(b, {}), 80)


def test_a_family_that_looks_ahead_is_caught(spark):
    made = linear(spark, 30)
    with pytest.raises(leakage.LeakageError):
        leakage.causal(made, lambda b: b.select("asset", "bar_ts", F.lead("close", 1).over(features.by_asset()).alias("x")), 20)


def test_target_as_feature_is_caught(spark):
    table = targets.PredictionTask("r", "regression", 5, targets.forward_return).table(linear(spark))
    copy = table.select("asset", "bar_ts", F.col("y").alias("x"))
    with pytest.raises(leakage.LeakageError):
        leakage.check_no_target_copy(copy, table, ["x"])


def test_registry(spark):
    registry = features.default_registry()
    assert registry.param_hash("baseline", {}) == registry.param_hash("baseline", {"window": 20}) != registry.param_hash("baseline", {"window": 10})
    with pytest.raises(KeyError):
        registry.get("none")
    with pytest.raises(LookupError):
        registry.get("field_adapter").apply(linear(spark), {})
    registry.register(features.FieldAdapter(lambda b, p: b.select("asset", "bar_ts", (F.col("close") * p["k"]).alias("field"))))
    out = registry.compose(linear(spark), [("baseline", {}), ("field_adapter", {"k": 2})])
    assert out.filter("field is null").count() == 0 and out.count() == 120


def test_peak_to_trough(spark):
    made = bars(spark, {"a": {0: 10.0, 1: 20.0, 2: 5.0, 3: 8.0}})
    row = targets.PredictionTask("p", "regression", 3, targets.peak_to_trough).table(made).orderBy("t_idx").first()
    assert row["y"] == pytest.approx(-0.75)


def test_normalise_takes_one_row_of_a_bar(spark):
    raw = spark.createDataFrame([("a", START, "1.5", 3.0), ("a", START, "2.5", 9.0)], "sym string, at timestamp_ntz, px string, volume double")
    rows = src.normalise(raw, {"asset": "sym", "bar_ts": "at", "close": "px"}).collect()
    assert len(rows) == 1 and rows[0]["close"] == 2.5 and rows[0]["open"] is None


def test_task_checks():
    with pytest.raises(ValueError):
        targets.PredictionTask("x", "ranking", 5, targets.forward_return)
    with pytest.raises(ValueError):
        targets.PredictionTask("x", "regression", 0, targets.forward_return)
