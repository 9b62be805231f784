"""Dispatch as a stream over a log of item transitions: state by item in buckets, decisions at every tick.

The log is an append-only folder of files of (id, job_id, seq, ts, status, stage, error_group, error). Each micro-batch
folds its transitions and merges them into the state table, whose touched buckets alone are rewritten. A state row keeps
the number of the last batch that changed it, so a batch that runs again after a failure changes nothing twice; the fold
doesn't mind in what order files come. After the merge the tick recovers stale items, chooses what to send and reports
the jobs' states; decisions are written by batch number, so that a repeated tick overwrites its own. The dispatcher
writes no transitions itself: whoever acts on a decision appends to the log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stackroom.config import CONFIG
from stackroom.operators.jobs import completion, dispatch, recover_stale
from stackroom.sources.buckets import BucketTable
from stackroom.sources.store import exists

LOG = "id long, job_id long, seq long, ts timestamp_ntz, status string, stage string, error_group string, error string"
STATE = "id long, job_id long, status string, stage string, attempt long, error_group string, last_error string, started_at timestamp_ntz, finished_at timestamp_ntz, updated_at timestamp_ntz, seq long, failed_seq long, staged_seq long, batch long"
DONE = ("done", "canceled")


def folded(log: DataFrame) -> DataFrame:
    """One row an item: its last transition, the first start, the last end and error, and how often it failed."""
    failed, at = F.col("status") == "failed", F.col("seq")
    staged = F.col("stage").isNotNull()
    out = log.groupBy("id").agg(
        F.max_by("job_id", "seq").alias("job_id"),
        F.max_by("status", "seq").alias("status"),
        F.max_by(F.when(staged, F.col("stage")), F.when(staged, at)).alias("stage"),
        F.count_if(failed).alias("attempt"),
        F.max_by("error_group", "seq").alias("error_group"),
        F.max_by(F.when(failed, F.col("error")), F.when(failed, at)).alias("last_error"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin(*DONE), F.col("ts"))).alias("finished_at"),
        F.max_by("ts", "seq").alias("updated_at"),
        F.max("seq").alias("seq"),
        F.max(F.when(failed, at)).alias("failed_seq"),
        F.max(F.when(staged, at)).alias("staged_seq"),
    )
    return out.withColumn("error_group", F.when(F.col("status") == "failed", F.col("error_group")))


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """State rows with a batch's folded rows taken in, but for those that have this batch already."""
    both = old.alias("o").join(new.alias("n"), F.col("o.id") == F.col("n.id"), "full_outer")
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    kept = n("id").isNull() | F.coalesce(o("batch") >= n("batch"), F.lit(False))

    def latest(c: str, by: str = "seq") -> Column:
        return F.when(n(by).isNotNull() & (o(by).isNull() | (n(by) >= o(by))), n(c)).otherwise(o(c))

    values = {
        "id": F.coalesce(o("id"), n("id")),
        **{c: latest(c) for c in ("job_id", "status", "error_group", "updated_at", "seq")},
        "stage": latest("stage", "staged_seq"),
        "attempt": F.coalesce(o("attempt"), F.lit(0)) + n("attempt"),
        "last_error": latest("last_error", "failed_seq"),
        "started_at": F.least(o("started_at"), n("started_at")),
        "finished_at": F.greatest(o("finished_at"), n("finished_at")),
        "failed_seq": F.greatest(o("failed_seq"), n("failed_seq")),
        "staged_seq": F.greatest(o("staged_seq"), n("staged_seq")),
        "batch": n("batch"),
    }
    return both.select(*(F.when(kept, o(c)).otherwise(values[c]).alias(c) if c != "id" else values[c].alias(c) for c in old.columns))


class Dispatcher:
    """State, decisions and checkpoint lie below path; a new Dispatcher on the same path goes on where the last one stopped."""

    def __init__(self, spark: SparkSession, log: str, path: str, now: Column, limits=None, most: int = CONFIG.max_attempts, buckets: int = 32):
        """limits(state) gives (job_id, high_water) of the jobs; without it the configured bound holds. most: attempts."""
        self.spark, self.log, self.path, self.now, self.limits, self.most = spark, log, path, now, limits, most
        if not BucketTable.there(spark, f"{path}/state"):
            BucketTable.create(spark.createDataFrame([], STATE), f"{path}/state", ("id",), buckets)

    @property
    def state(self) -> BucketTable:
        return BucketTable.open(self.spark, f"{self.path}/state")

    def tick(self, batch: DataFrame, number: int) -> None:
        new = folded(batch).withColumn("batch", F.lit(number).cast("long"))
        self.state.upsert(new, merged)
        current = recover_stale(self.state.read(), self.now)
        chosen = dispatch(current, most=self.most, limits=self.limits(current) if self.limits else None)
        for name, rows in (("stale", current.filter("recovered").select("id", "attempt")), ("dispatch", chosen), ("jobs", completion(current, self.most))):
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={number}")

    def start(self, files_each: int = 1) -> StreamingQuery:
        """Everything that the log holds now, so many files a batch."""
        stream = self.spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_each).parquet(self.log)
        return stream.writeStream.foreachBatch(self.tick).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()

    def run(self, files_each: int = 1) -> DataFrame:
        """Work through the log; the state."""
        query = self.start(files_each)
        query.awaitTermination()
        return self.state.read()

    def decided(self, name: str) -> DataFrame:
        """What the last tick decided: stale, dispatch or jobs."""
        number = self.state.read().agg(F.max("batch")).head()[0]
        if number is None:
            raise ValueError("no tick has run")
        while exists(self.spark, f"{self.path}/{name}/batch={number + 1}"):  # a batch without rows leaves no mark in the state
            number += 1
        return self.spark.read.parquet(f"{self.path}/{name}/batch={number}")
