"""Folders that driver and executors share, for tables that outlive a query's plan: indexes, state, staged files."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a temporary folder, which only a local master can share."""
    sc = spark.sparkContext
    if (have := sc._jsc.sc().getCheckpointDir()).isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="stackroom-store-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the program ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        target, fs = _at(spark, path)
        fs.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target, fs = _at(spark, path)
    return fs.exists(target)


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
