"""Small text files in whatever store Spark can reach, by Hadoop's file systems."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    sc = spark.sparkContext
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(sc._jsc.hadoopConfiguration())


def join(*parts: str) -> str:
    return "/".join([parts[0].rstrip("/"), *(p.strip("/") for p in parts[1:])])


def write_text(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> None:
    """The whole file at once; with ``overwrite`` off it must not be there yet."""
    where, store = _at(spark, path)
    out = store.create(where, overwrite)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where, store = _at(spark, path)
    stream = store.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def exists(spark: SparkSession, path: str) -> bool:
    where, store = _at(spark, path)
    return store.exists(where)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder; none if there is no folder."""
    where, store = _at(spark, folder)
    return sorted(f.getPath().getName() for f in store.listStatus(where)) if store.exists(where) else []


def complete(spark: SparkSession, table: str) -> bool:
    """Whether a table was written to its end."""
    return exists(spark, join(table, "_SUCCESS"))
