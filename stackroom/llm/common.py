"""Helpers shared by the corpus operators: Arrow streaming, checkpoints, table access."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stackroom.session import small_batches  # noqa: F401  the operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset."""
    sc = spark.sparkContext
    have = sc._jsc.sc().getCheckpointDir()
    if have.isDefined():
        return have.get()
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named:
        named = tempfile.mkdtemp(prefix="corpus-ckpt-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; its files go when the frame is no longer referenced."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the shared folder; it goes when the program ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tidy_shuffles(spark: SparkSession):
    """Within it, the shuffle files of each action go when the action ends; else they stay until a collection of the
    driver's garbage happens to come."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fresh(names: Iterable[str], *wanted: str) -> list[str]:
    """Names like those wanted that none of the names clashes with, whatever their case."""
    taken, mark = {n.lower() for n in names}, ""
    while any(f"{w}{mark}".lower() in taken for w in wanted):
        mark += "_"
    return [f"{w}{mark}" for w in wanted]


def doc_hash(col, mod: int):
    """crc32 of the decimal id, modulo mod; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextlib.contextmanager
def quiet_gc():
    """Large caches of strings make the cycle collector slow; it is off within a task. After it, free memory goes back
    to the system, since a worker lives on beside tasks that need none."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # another C library has no such call
            ctypes.CDLL(None).malloc_trim(0)


def portions(texts: list[str], most: int = 1 << 22) -> Iterator[list[str]]:
    """Runs of texts of about so many characters together."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield texts[start:i]
            start, size = i, 0
        size += len(t)
    if texts:
        yield texts[start:]
