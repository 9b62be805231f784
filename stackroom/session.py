"""Sessions, and the package's own code on the workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows per Arrow batch. Long documents would make the default of 10,000 rows too large for a worker.
BATCH_ROWS = 1000
#: Bytes after which an Arrow batch ends, whatever its rows.
BATCH_BYTES = 16 << 20

_shipped: set[str] = set()


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC and adaptive execution; partitions defaults to Spark's own setting on a cluster."""
    builder = SparkSession.builder.master(master).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once an application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="stackroom-"), "stackroom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of one Arrow batch, and see that the workers have this code."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
