"""Streams over the driver's events: files of a log, worked through batch by batch with state on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stackroom.operators.jobs import IN_FLIGHT
from stackroom.sources.store import scratch
from stackroom.streaming import timers
from stackroom.streaming.dispatcher import Dispatcher

from .job_queries import _LIMIT, _NEXT, _NOW
from .registry import ITEMS, items, now, query, table

#: The log: a user's events are transitions of one item.
LOG_SQL = f"""{ITEMS}, log AS (SELECT e.user_id AS id, i.job_id, i.id AS seq, i.updated_at AS ts, i.status, i.stage, i.error_group, i.last_error AS error FROM items i JOIN events e ON i.id = e.event_id),
    state AS (SELECT id, arg_max(job_id, seq) AS job_id, arg_max(status, seq) AS status, arg_max(stage, seq) AS stage, count(*) FILTER (status = 'failed') AS attempt, CASE WHEN arg_max(status, seq) = 'failed' THEN arg_max(coalesce(error_group, ''), seq) END AS g,
        arg_max(error, seq) FILTER (status = 'failed') AS last_error, min(ts) FILTER (status = 'running') AS started_at, max(ts) FILTER (status = 'done') AS finished_at, arg_max(ts, seq) AS updated_at, max(seq) AS seq FROM log GROUP BY id)"""


def _dispatcher(spark, d, files: int = 3) -> Dispatcher:
    """A dispatcher that has worked through the events, dealt to files by time."""
    users = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    log = items(spark, d).join(users, "id").select(F.col("user_id").alias("id"), "job_id", F.col("id").alias("seq"), F.col("updated_at").alias("ts"), "status", "stage", "error_group", F.col("last_error").alias("error"))
    path = scratch(spark, "dispatch")
    log.repartitionByRange(files, "ts").write.parquet(f"{path}/log")
    busy = F.count_if(F.col("status").isin(IN_FLIGHT)) + F.floor(F.count(F.lit(1)) / 5)
    limits = lambda state: state.groupBy("job_id").agg(busy.alias("high_water"))  # noqa: E731  room for a fifth of each job
    out = Dispatcher(spark, f"{path}/log", path, now(), limits, most=1_000_000)  # users fail often
    out.run()
    return out


@query(f"WITH {LOG_SQL} SELECT id, job_id, status, stage, attempt, nullif(g, '') AS error_group, last_error, started_at, finished_at, updated_at, seq FROM state")
def stm06_fold_stream(spark, d) -> DataFrame:
    return _dispatcher(spark, d).state.read().drop("failed_seq", "staged_seq", "batch")


@query(f"""WITH {LOG_SQL}, s AS (SELECT *, status IN ('dispatched', 'running') AND epoch_us({_NOW}) - epoch_us(updated_at) > ({_LIMIT})::BIGINT * 1000000 AS stale FROM state),
    c AS (SELECT id, job_id, stage, CASE WHEN stale THEN 'failed' ELSE status END AS status, attempt + CAST(stale AS INTEGER) AS attempt FROM s),
    b AS (SELECT job_id, count(*) FILTER (status IN ('dispatched', 'running')) AS busy, count(*) FILTER (status IN ('dispatched', 'running')) + count(*) // 5 AS high_water FROM c GROUP BY job_id),
    w AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY id) AS place FROM c WHERE status IN ('pending', 'failed'))
    SELECT w.job_id, id, CAST(place AS INTEGER) AS place, CASE WHEN {_NEXT} IS NULL THEN 'done' ELSE 'dispatched' END AS status, {_NEXT} AS next_stage FROM w JOIN b USING (job_id) WHERE place <= high_water - busy""")
def stm02_dispatch_stream(spark, d) -> DataFrame:
    """What the last tick of the stream sends."""
    return _dispatcher(spark, d).decided("dispatch")


@query(f"WITH {ITEMS}, s AS (SELECT *, status IN ('dispatched', 'running') AND epoch_us({_NOW}) - epoch_us(updated_at) > ({_LIMIT})::BIGINT * 1000000 AS stale FROM items) SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN 'stale' ELSE error_group END AS error_group, CAST(attempt + CAST(stale AS INTEGER) AS BIGINT) AS attempt FROM s")
def stm03_timer_stream(spark, d) -> DataFrame:
    """Stale items by timers of a stateful stream; two last files hold nothing but the clock's time."""
    late, path = "40 days", scratch(spark, "timers")
    log = items(spark, d).select("id", F.col("id").alias("seq"), F.col("updated_at").alias("ts"), "status", "stage", "error_group", F.col("attempt").cast("long").alias("attempt"))
    files = max(2, spark.sparkContext.defaultParallelism)  # of one batch, so that every core writes and reads some
    log.repartitionByRange(files, "ts").write.parquet(f"{path}/log/1")
    clock = spark.range(1).select(*(F.lit(None).cast(f.dataType).alias(f.name) if f.name != "ts" else (now() + F.expr(f"INTERVAL {late}")).alias("ts") for f in log.schema))
    for i in (2, 3):
        clock.coalesce(1).write.parquet(f"{path}/log/{i}")
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/log/*")
    return timers.current(timers.run_watched(stream, path, late))
