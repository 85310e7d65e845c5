"""Cutting lineage where a table is used several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    _ready(spark)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/foldspark-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` from the shared checkpoint folder, computed once."""
    _ready(df.sparkSession)
    return df.checkpoint(eager=True)


def _ready(spark: SparkSession) -> None:
    """The folder is the one named in ``spark.checkpoint.dir``; one of our own is set
    only where the session has none, as in tests on one machine."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="foldspark-"))
