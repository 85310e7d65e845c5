"""What the operators share: the shared folder, shipping this code, hashing rules."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of a batch that Spark hands to Python, where the session says nothing: texts are long.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
_PACKAGE = Path(__file__).resolve().parents[1]
_shipped: set[str] = set()


def ready(spark: SparkSession) -> SparkSession:
    """Make checkpoints and this package usable from every executor, and batches of texts small.

    The checkpoint folder is the one named in ``spark.checkpoint.dir``; a folder
    of our own is set only where none is named, as in tests on one machine.
    """
    sc = spark.sparkContext
    for name, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    if not spark.conf.get("spark.checkpoint.dir", None) and sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foldspark-"))
    if sc.applicationId not in _shipped:
        _shipped.add(sc.applicationId)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w") as z:
            z.write(_PACKAGE / "__init__.py", f"{_PACKAGE.name}/__init__.py")
            for p in sorted((_PACKAGE / "llm").glob("*.py")):
                z.write(p, f"{_PACKAGE.name}/llm/{p.name}")
        path = os.path.join(tempfile.mkdtemp(prefix="foldspark-code-"), "foldspark_llm.zip")
        Path(path).write_bytes(data.getvalue())
        sc.addPyFile(path)
    return spark


def shared_uri(spark: SparkSession) -> str:
    """A new folder, as a URI, below the shared checkpoint folder."""
    import uuid

    ready(spark)
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = named or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{root.rstrip('/')}/foldspark-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, m: int) -> Column:
    """crc32 of the key as text, modulo ``m``; a null key counts as empty text."""
    c = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % m


def materialised(df: DataFrame, free: bool = True) -> DataFrame:
    """Cut the lineage with a table in the shared folder, and with ``free`` let go of the shuffle files behind it.

    Spark removes shuffle files when the driver has collected what refers to them,
    which a driver with little to do puts off for long; so it is asked to.
    """
    spark = df.sparkSession
    folder = f"{shared_uri(spark)}/table"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(folder)
    del df
    if free:
        release(spark)
    return spark.read.schema(schema).parquet(folder)


def release(spark: SparkSession) -> None:
    """Ask the driver to collect what nothing refers to, so that shuffle files of such tables go.
    Inside :func:`materialised` the caller still holds its argument; called afterwards, this frees that too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def with_computed(df: DataFrame, column: str, fields: str, start: Callable[[], Callable[[pa.Array], Iterator[list[pa.Array]]]]) -> DataFrame:
    """``df`` with the fields (``name type, ...``) computed from one column; columns of these names are replaced.

    Only that column goes to Python.  ``start`` runs once a task; what it returns turns
    a batch into arrays of the fields, for some rows at a time and in their order.
    """
    names = [f.strip().split(" ", 1)[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        apply = start()
        for batch in batches:
            for arrays in apply(batch):
                yield pa.StructArray.from_arrays(arrays, names)

    # "Non-deterministic" keeps Spark from moving filters on the result below it and computing it twice.
    made = F.arrow_udf(_with_batches(run), fields).asNondeterministic()
    others = [c for c in df.columns if c not in names]
    return df.withColumn("_foldspark_made", made(F.col(column))).select(*(F.col(f"`{c}`") for c in others), *(F.col(f"_foldspark_made.{n}").alias(n) for n in names))


def _with_batches(run: Callable) -> Callable:
    """With evaluated type hints, by which Spark tells functions over iterators."""
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run
