"""Cutting lineage: tables in the folder that driver and executors share, and their removal."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a temporary folder serves on one machine; on a cluster that is an error, as
    each executor would write to its own disk.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='pathlight-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def _hadoop(spark: SparkSession, path: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def cut(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again.

    The shuffle files of the step go as it ends. The table goes by `discard`, or with the session.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pathlight/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    fs, at = _hadoop(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables that `cut` wrote. Nothing that is still to run may read them."""
    for table in tables:
        fs, at = _hadoop(table.sparkSession, _paths.pop(table))
        fs.delete(at, True)
