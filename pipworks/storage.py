"""Intermediate tables in the folder that every executor can reach.

Iterative operators cut their lineage by writing a table and reading it again. The tables lie under the folder named in
`spark.checkpoint.dir`, so they survive the loss of an executor; without that setting
only local sessions run, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`; in local sessions, as in tests, a temporary one of this process where it is unset."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = "file://" + tempfile.mkdtemp(prefix="pipworks-")
    return _fallback[app]


def spread(df: DataFrame) -> DataFrame:
    """Rows in as many tasks as a shuffle has, before work that is heavy for the bytes of its rows, which adaptive execution would put into few."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


class Scratch:
    """Named intermediate tables of one operator run, each written once and read back from storage."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/pipworks/{purpose}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None, mode: str = "errorifexists") -> DataFrame:
        """Writes `df` under `name` and returns the stored table."""
        writer = df.write.mode(mode)
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        """Removes one table, or all of them. Only for tables that nothing reads any more."""
        delete(self.spark, self.path(name) if name else self.root)


def delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def read_text(spark: SparkSession, path: str) -> str:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).open(jpath)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if there is no such folder."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(jpath)] if fs.exists(jpath) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that isn't there yet: under another name first, then renamed, so that no reader sees half of it and nothing is ever removed."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex[:8]}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if fs.exists(target) or not fs.rename(part, target):
        fs.delete(part, False)
        raise FileExistsError(path)
