import pytest
from pyspark.sql import functions as F

from foldspark.functions.features import Baseline, CrossAsset, Regime
from foldspark.sources.bars import event_bars
from foldspark.streaming import live

SF = "/root/testdata/sf0.001"


def test_stream_bars_are_batch_bars_and_get_scored(spark, tmp_path):
    trades = spark.read.parquet(f"{SF}/events.parquet").select(F.col("event_type").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "value", "event_id").orderBy("ts")
    later = trades.agg(F.max("ts").alias("ts")).select(F.lit("none").alias("asset"), (F.col("ts") + F.expr("interval 3 days")).alias("ts"), F.lit(0.0).alias("value"), F.lit(-1).cast("long").alias("event_id"))
    trades.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    later.coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    coefs = spark.createDataFrame([(1.0, [2.0])], "intercept double, coefs array<double>")
    query = live.run_scoring(live.stream_bars(stream), lambda b: b, coefs, ["close"], str(tmp_path / "out"), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    got = spark.read.parquet(str(tmp_path / "out")).filter("asset <> 'none'")
    want = event_bars(spark, SF)
    assert got.join(want.withColumnRenamed("close", "c"), ["asset", "bar_ts"]).filter("abs(close - c) > 1e-9 or abs(pred - 1 - 2 * c) > 1e-9").count() == 0
    assert got.count() == want.count()


def test_features_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    bars = event_bars(spark, SF).cache()
    days = [r[0] for r in bars.select(F.date_trunc("week", "bar_ts").alias("d")).distinct().orderBy("d").collect()]
    for k, d in enumerate(days[:6]):
        late = F.date_trunc("week", "bar_ts") >= F.lit(d) if k == 5 else F.date_trunc("week", "bar_ts") == F.lit(d)
        bars.filter(late).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    n = min(len(days), 6)
    for family in (Baseline(), Regime()):
        at = lambda x: str(tmp_path / f"{family.name}-{x}")  # noqa: E731, B023
        stream = lambda: spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = live.run_features(stream(), family, {}, at("out"), at("state"), at("cp"))
        query.processAllAvailable()
        query.stop()
        got = spark.read.parquet(at("out"))
        assert got.select("batch").distinct().count() == n
        want = family.apply(bars, {})
        assert sorted(map(str, got.drop("batch").select(*want.columns).collect())) == sorted(map(str, want.collect()))
        assert spark.read.parquet(f"{at('state')}/{(n - 1) % 2}").groupBy("asset").count().filter(F.col("count") > family.memory({})).isEmpty()
    with pytest.raises(ValueError):
        live.run_features(bars, CrossAsset(), {}, "", "", "")
