"""Ingestion jobs as set operations over a table of items: plan, dispatch, recover, complete, retry, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stackroom.config import CONFIG
from stackroom.operators.tables import first_wins

IN_FLIGHT, WAITING = ["dispatched", "running"], ["pending", "failed"]


def plan(manifest: DataFrame, objects: DataFrame, known: DataFrame, embedded: DataFrame, again: bool = False) -> DataFrame:
    """Each manifest row with what to do: the first reason of skip, duplicate, missing_object, missing_meta, already_embedded, else ingest."""
    rows = manifest.withColumn("place", F.row_number().over(Window.partitionBy("book_id").orderBy("seq")))
    rows = rows.withColumn("object_key", F.coalesce("object_key", F.format_string("originals/%s/%s.pdf", "book_id", "book_id")))
    flag = lambda df, key, name: df.select(key).distinct().withColumn(name, F.lit(True))
    rows = rows.join(flag(objects, "object_key", "has_object"), "object_key", "left").join(flag(known, "book_id", "has_meta"), "book_id", "left").join(flag(embedded, "book_id", "has_vectors"), "book_id", "left")
    action = F.when(F.coalesce(F.col("book_id"), F.lit("")) == "", "skip").when(F.col("place") > 1, "duplicate").when(F.col("has_object").isNull(), "missing_object").when(F.col("has_meta").isNull(), "missing_meta")
    if not again:
        action = action.when(F.col("has_vectors").isNotNull(), "already_embedded")
    return rows.select("seq", "book_id", "object_key", action.otherwise("ingest").alias("action"))


def plan_report(planned: DataFrame) -> DataFrame:
    return planned.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


def next_stage(stage: Column) -> Column:
    """The first stage left after a checkpoint; null when none is left."""
    out = F.lit(CONFIG.stages[0])
    for name, left in CONFIG.remaining.items():
        out = F.when(stage == name, F.lit(left[0] if left else None).cast("string")).otherwise(out)
    return out


def stage_timeout(stage: Column) -> Column:
    return reduce(lambda out, kv: F.when(stage == kv[0], kv[1]).otherwise(out), CONFIG.stage_seconds.items(), F.lit(CONFIG.stage_seconds["extract"]))


def recover_stale(items: DataFrame, now: Column) -> DataFrame:
    """In-flight items without a sign of life for longer than their limit become failed, with one attempt more."""
    limit = F.when(F.col("status") == "dispatched", CONFIG.stale_seconds).otherwise(stage_timeout(F.coalesce(next_stage(F.col("stage")), F.lit("extract"))))
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    stale = F.col("status").isin(IN_FLIGHT) & (age > limit.cast("long") * 1_000_000)
    stale = F.coalesce(stale, F.lit(False))
    return items.withColumns({"status": F.when(stale, "failed").otherwise(F.col("status")), "error_group": F.when(stale, "stale").otherwise(F.col("error_group")), "attempt": F.col("attempt") + stale.cast("int"), "recovered": stale})


def dispatch(items: DataFrame, high_water: int = CONFIG.high_water, most: int = CONFIG.max_attempts, limits: DataFrame | None = None) -> DataFrame:
    """Items to send next, oldest first, as many as each job has free slots; finished ones go straight to done.

    At most high_water rows of a job pass the ranking, which the planner applies within each task first. limits names
    jobs (job_id, high_water) with a bound of their own.
    """
    busy = items.filter(F.col("status").isin(IN_FLIGHT)).groupBy("job_id").agg(F.count(F.lit(1)).alias("busy"))
    waiting = items.filter(F.col("status").isin(WAITING) & (F.col("attempt") < most))
    first = waiting.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("id")))
    if limits is None:
        bound = F.lit(high_water)
        first = first.filter(F.col("place") <= high_water)
    else:
        bound = F.coalesce("high_water", F.lit(high_water))
        busy = busy.join(limits.select("job_id", "high_water"), "job_id", "full_outer")
    chosen = first.join(busy, "job_id", "left").filter(F.col("place") <= bound - F.coalesce("busy", F.lit(0)))
    return chosen.select("job_id", "id", "place", F.when(next_stage(F.col("stage")).isNull(), "done").otherwise("dispatched").alias("status"), next_stage(F.col("stage")).alias("next_stage"))


def completion(items: DataFrame, most: int = CONFIG.max_attempts) -> DataFrame:
    """Per job its counts, and the state it is in now."""
    flying, failed = F.col("status").isin(IN_FLIGHT), F.col("status") == "failed"
    counts = items.groupBy("job_id").agg(F.count_if(flying).alias("in_flight"), F.count_if(F.col("status").isin(WAITING) & (F.col("attempt") < most)).alias("eligible"), F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("total"))
    state = F.when((F.col("in_flight") > 0) | (F.col("eligible") > 0), "running").when(F.col("failed") > 0, "completed_with_errors").otherwise("completed")
    return counts.withColumn("state", state)


def retry(items: DataFrame, group: str | None = None, stage: str | None = None, ids: list[int] | None = None) -> DataFrame:
    """Failed items (of a group, or of these ids) wait again; with stage their checkpoint goes back to it."""
    chosen = F.col("status") == "failed"
    if group is not None:
        chosen = chosen & F.col("error_group").eqNullSafe(F.lit(group))
    if ids is not None:
        chosen = chosen & F.col("id").isin(ids)
    out = {"status": F.when(chosen, "pending").otherwise(F.col("status")), "attempt": F.when(chosen, 0).otherwise(F.col("attempt")), "error_group": F.when(chosen, F.lit(None)).otherwise(F.col("error_group"))}
    if stage:
        out["stage"] = F.when(chosen, stage).otherwise(F.col("stage"))
    return items.withColumns(out)


def control(items: DataFrame, action: str) -> DataFrame:
    """Cancelling touches items that wait; other actions change jobs only."""
    if action != "cancel":
        return items
    return items.withColumn("status", F.when(F.col("status").isin(WAITING), "canceled").otherwise(F.col("status")))


def error_group(kind: Column, message: Column) -> Column:
    text = F.lower(F.coalesce(message, F.lit("")))
    return F.when(kind.rlike("Timeout"), "llm_timeout").when(kind.rlike("^HTTP"), "llm_error").when(text.contains("milvus") | F.lower(kind).startswith("milvus"), "milvus_error").when((kind == "S3Error") | text.contains("minio"), "minio_error").when(text.contains("vlm"), "vlm_error").otherwise("unknown")


def last_hour(at: Column, now: Column) -> Column:
    """Does a time lie within the hour that ends now?"""
    return at.cast("timestamp") >= now.cast("timestamp") - F.expr("INTERVAL 1 HOUR")


def progress(items: DataFrame, now: Column) -> DataFrame:
    """Per job: items done in the last hour, and hours left at that rate (null at rate 0)."""
    recent = (F.col("status") == "done") & last_hour(F.col("updated_at"), now)
    counts = items.groupBy("job_id").agg(F.count_if(recent).alias("rate_per_hour"), F.count_if(F.col("status").isin([*IN_FLIGHT, *WAITING])).alias("left"))
    return counts.withColumn("eta_hours", F.when(F.col("rate_per_hour") > 0, F.round(F.col("left") / F.col("rate_per_hour"), 1)))


def failures(items: DataFrame, sample: int = 300) -> DataFrame:
    return items.filter("status = 'failed'").groupBy(F.coalesce("error_group", F.lit("unknown")).alias("error_group")).agg(F.count(F.lit(1)).alias("n"), F.substring(F.max("last_error"), 1, sample).alias("sample"))


def fold_events(events: DataFrame) -> DataFrame:
    """Current item rows of a log of transitions (id, seq, ts, status, error)."""
    return events.groupBy("id").agg(F.max_by("status", "seq").alias("status"), F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.count_if(F.col("status") == "failed").alias("attempt"), F.max_by(F.when(F.col("status") == "failed", F.col("error")), "seq").alias("last_error"))


def manifest_rows(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    return first_wins(manifest, ["book_id"], ["seq"])
