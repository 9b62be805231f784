"""Items with timers: a stream in which each item's silence itself becomes a transition.

Every transition of an item is kept as its state, with the moment at which the item counts as stale; the next transition
takes that back. When the watermark reaches it, the item fails with the group "stale" and one attempt more. Finished
items keep their state for a while (a late transition of one isn't taken for a new item), then their moment clears it,
so that state doesn't grow with the items ever seen.

A call on state goes from Python to the JVM and back and takes far longer than an item's work, so neighbouring ids share
theirs: a cell of CELL ids is one key with one value of state and one timer, set to the earliest moment among its items.
Rows come and go as pandas frames, which Spark passes on several times faster than rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stackroom.config import CONFIG
from stackroom.operators.jobs import IN_FLIGHT, next_stage, stage_timeout
from stackroom.session import ship

from .dispatcher import DONE

CHANGES = "id long, seq long, status string, error_group string, attempt long, due boolean"
#: Ids of a cell, a power of two. It bounds what is rewritten for one transition; a checkpoint goes on with the same value only.
CELL = 512
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Null among numbers that go to pandas, where a null would turn its column into floats; as a cell, rows without an id.
NULL = -(1 << 63)
#: The last day that pandas knows; the watermark, not the items' moments, ends there.
LAST = "2262-04-10"
NEW = (-1, None, None, 0, None)
CHANGE = Row("id", "seq", "status", "error_group", "attempt", "due")
Items = dict[int, tuple[int, str | None, str | None, int, int | None]]


class ItemTimers(StatefulProcessor):
    """Of each item of a cell: seq, status, error_group, attempt and its moment in milliseconds (none: it waits for nothing).

    keep: milliseconds for which a finished item's state stays.
    """

    def __init__(self, keep: int):
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("items", "items string")

    def _kept(self) -> Items:
        kept = self.item.get()
        return {i: tuple(x) for i, *x in json.loads(kept[0])} if kept else {}

    def _put(self, items: Items) -> None:
        if items:
            self.item.update((json.dumps([(i, *x) for i, x in items.items()], separators=(",", ":")),))
        else:
            self.item.clear()

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        if key[0] == NULL:  # rows that only move the clock
            return
        items, changed = self._kept(), False
        before = _earliest(items)
        for r in sorted(rows, key=lambda r: r["seq"]):
            seq, status, group, attempt, at = items.get(r["id"], NEW)
            if r["seq"] <= seq:  # came again, or too late
                continue
            seq, status, at = r["seq"], r["status"], None
            group = r["error_group"] if status == "failed" else None
            attempt = r["attempt"] if r["attempt"] is not None else attempt + (status == "failed")
            if r["at_ms"] is not None and status in IN_FLIGHT:
                at = r["at_ms"] + r["limit_ms"] + 1
            elif r["at_ms"] is not None and status in DONE:
                at = r["at_ms"] + self.keep
            items[r["id"]], changed = (seq, status, group, attempt, at), True
            yield CHANGE(r["id"], seq, status, group, attempt, False)
        if not changed:
            return
        self._put(items)
        after = _earliest(items)
        if after == before:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        if after is not None:
            self.handle.registerTimer(after)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        items, clock = self._kept(), timerValues.getCurrentWatermarkInMs()
        for i in [i for i, x in items.items() if x[-1] is not None and x[-1] <= clock]:
            seq, status, _, attempt, _ = items[i]
            if status in IN_FLIGHT:
                items[i] = (seq, "failed", "stale", attempt + 1, None)
                yield CHANGE(i, seq, "failed", "stale", attempt + 1, True)
            else:
                del items[i]
        self._put(items)
        after = _earliest(items)
        if after is not None:  # Spark takes back the one that fired
            self.handle.registerTimer(after)

    def close(self) -> None:
        pass


class FrameTimers(ItemTimers):
    """ItemTimers that takes and gives pandas frames."""

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        yield from _frame(super().handleInputRows(key, _rows(rows), timerValues))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from _frame(super().handleExpiredTimer(key, timerValues, expiredTimerInfo))


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for f in frames:
        whole = {c: f[c].tolist() for c in ("id", "limit_ms")}
        numbers = {c: [None if v == NULL else v for v in f[c].tolist()] for c in ("seq", "attempt", "at_ms")}
        texts = {c: [v if isinstance(v, str) else None for v in f[c].tolist()] for c in ("status", "error_group")}
        columns = {**whole, **numbers, **texts}
        yield from (dict(zip(columns, values)) for values in zip(*columns.values()))


def _frame(changes: Iterator[Row]) -> Iterator[pd.DataFrame]:
    if rows := list(changes):
        yield pd.DataFrame(rows, columns=list(CHANGE))


def _earliest(items: Items) -> int | None:
    return min((x[-1] for x in items.values() if x[-1] is not None), default=None)


def watched(log: DataFrame, late: str = "10 minutes", keep_hours: int = 24) -> DataFrame:
    """Changes of items (CHANGES) of a streaming log of (id, seq, ts, status, stage, error_group, attempt).

    attempt is the count that a log carries itself, or null if failures are to be counted here. A row with due is a
    timer's. Rows of a null id only move the clock.
    """
    spark = log.sparkSession
    ship(spark)
    limit = F.when(F.col("status") == "dispatched", CONFIG.stale_seconds).otherwise(stage_timeout(F.coalesce(next_stage(F.col("stage")), F.lit("extract"))))
    at = F.col("ts").cast("timestamp")
    last = F.lit(LAST).cast("timestamp")
    cell, number = F.shiftright("id", CELL.bit_length() - 1), (lambda c: F.coalesce(c.cast("long"), F.lit(NULL)))
    rows = log.select(number(cell).alias("cell"), number(F.col("id")).alias("id"), number(F.col("seq")).alias("seq"), F.when(at > last, last).otherwise(at).alias("ts"), "status", "error_group", number(F.col("attempt")).alias("attempt"), (limit * 1000).cast("long").alias("limit_ms"), number(F.unix_millis(at)).alias("at_ms"))
    return rows.withWatermark("ts", late).groupBy("cell").transformWithStateInPandas(FrameTimers(keep_hours * 3_600_000), CHANGES, "Append", "EventTime")


def run_watched(log: DataFrame, path: str, late: str = "10 minutes", keep_hours: int = 24) -> DataFrame:
    """Work through what the log holds now; all changes so far, as a table below path."""
    spark = log.sparkSession
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)  # timers need a store that sorts; a query keeps what holds at its start
    try:
        query = watched(log, late, keep_hours).writeStream.format("parquet").option("path", f"{path}/changes").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
    query.awaitTermination()
    return spark.read.schema(CHANGES).parquet(f"{path}/changes")


def current(changes: DataFrame) -> DataFrame:
    """The last state of each item; a timer's change follows the transition it waited for."""
    last = F.struct("seq", "due")
    return changes.groupBy("id").agg(*(F.max_by(c, last).alias(c) for c in ("status", "error_group", "attempt")))
