"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_WRITTEN: list[str] = []
#: path of each table that `materialise` returned, while the caller holds it
_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    ``spark.checkpoint.dir`` of the session when set. Otherwise, and only with a
    single-process local master, a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="weftline-"))
    return _OWN_DIR[0]


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and returns the table as read back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/weftline-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def _at_exit() -> None:
    """Deletes what this process wrote to folders that it can reach itself; elsewhere `release` is for the caller."""
    for path in _WRITTEN:
        local = path.removeprefix("file://")
        if os.path.isabs(local):
            shutil.rmtree(local, ignore_errors=True)


atexit.register(_at_exit)


def release(spark: SparkSession) -> None:
    """Deletes the tables that `materialise` wrote; call it once results are stored."""
    while _WRITTEN:
        _delete(spark, _WRITTEN.pop())


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `materialise` returned. Only for those whose readers have all been written themselves: later plans, retries included, then start from these."""
    for table in tables:
        path = _PATHS.pop(table)
        _WRITTEN.remove(path)
        _delete(table.sparkSession, path)


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
