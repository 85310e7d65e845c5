"""What the examples share: a session, hourly event bars as the vendor, where runs go."""

from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from pyspark.sql import SparkSession  # noqa: E402

from foldspark.operators.folds import ValidationSpec  # noqa: E402
from foldspark.plans.inspect import Run, load_run  # noqa: E402
from foldspark.plans.runner import Runner  # noqa: E402
from foldspark.sources.bars import event_bars  # noqa: E402
from foldspark.sources.vendors import TableVendor  # noqa: E402

SF = os.environ.get("EXAMPLE_SF_DIR", "/root/testdata/sf0.01")
OUTER = ValidationSpec(min_train_size=300, test_size=100, embargo=20)
INNER = ValidationSpec(min_train_size=120, test_size=50, embargo=20)


def runner() -> Runner:
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    root = os.environ.get("EXAMPLE_RUNS", tempfile.mkdtemp(prefix="runs-"))
    return Runner(spark, root, {"events": TableVendor(lambda s: event_bars(s, SF))}, cache=f"{root}-features")


def run(recipe) -> Run:
    r = runner()
    return load_run(r.spark, r.root, r.run(recipe.compile()))
