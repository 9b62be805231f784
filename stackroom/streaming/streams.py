"""Structured Streaming: windows, sessions, late data, stream joins, item logs, reply splitting, dispatch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stackroom.operators.jobs import completion, dispatch, recover_stale
from stackroom.session import ship


def timed(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """events with ts as a timestamp with zone, which a watermark needs."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "2 hours") -> DataFrame:
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), "n")


def once(events: DataFrame, keys: list[str]) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def followed(first: DataFrame, second: DataFrame, within: str = "1 hour") -> DataFrame:
    """Events of a user that another one follows within an interval.

    Rows meet by user and by cells of time as long as the interval, so a busy user's events meet their neighbours only.
    """
    length = int(pd.Timedelta(within).total_seconds() * 1_000_000)
    cell = lambda c: F.floor(F.unix_micros(c.cast("timestamp")) / F.lit(length))
    a = first.withColumn("cell", F.explode(F.array(cell(F.col("ts")), cell(F.col("ts")) + 1))).alias("a")
    b = second.withColumn("cell", cell(F.col("ts"))).alias("b")
    near = (F.col("b.ts") > F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.cell") == F.col("b.cell")) & near).select(F.col("a.event_id").alias("event_id"), F.col("b.event_id").alias("next_id"))


class ReplySplitter:
    """Parts of a streamed reply: a first #KW: line, the text, and the effect behind a marker that may straddle deltas."""

    LABELS = ("추천 이유", "추천이유", "독후 효과", "독후효과")

    def __init__(self, marker: str = "###EFFECT###", most: int = 5, buffer: str = "", phase: str = "keywords", fresh: bool = True, opening: bool = False):
        self.marker, self.most, self.buffer, self.phase, self.fresh, self.opening = marker, most, buffer, phase, fresh, opening

    def _label(self, last: bool) -> bool:
        """Drop a label that opens the part; False while more is needed to tell."""
        if not self.fresh:
            return True
        bare = self.buffer.lstrip().lstrip("#*[ ").lstrip()
        if not last and "\n" not in self.buffer and any(x.startswith(bare[: len(x)]) for x in self.LABELS):
            return False
        line, cut, rest = self.buffer.partition("\n")
        if any(line.strip().strip("#*[]: ：").startswith(x) and len(line.strip().strip("#*[]: ：")) <= len(x) for x in self.LABELS):
            self.buffer = rest if cut else ""
        self.fresh = False
        return True

    def feed(self, delta: str, last: bool = False) -> Iterator[tuple[str, str]]:
        self.buffer += delta
        if self.phase == "keywords":
            if "\n" not in self.buffer and not last:
                return
            line, _, rest = self.buffer.partition("\n")
            if line.strip().startswith("#KW"):
                words = [w for w in map(str.strip, line.strip()[4:].split(",")) if w]
                if words:
                    yield "keywords", ",".join(words[: self.most])
                self.buffer = rest
            self.phase = "text"
        if self.phase == "text":
            if not self._label(last):
                return
            before, mark, after = self.buffer.partition(self.marker)
            if mark:
                if before:
                    yield "text", before
                self.phase, self.buffer, self.fresh, self.opening = "effect", after, True, True
            else:
                safe = len(before) if last else max(0, len(before) - len(self.marker) + 1)
                if before[:safe].strip() or (safe and not last):
                    yield "text", before[:safe]
                self.buffer = before[safe:]
                return
        if self.opening:  # line feeds behind the marker may come with a later delta
            self.buffer = self.buffer.lstrip("\n")
            self.opening = not self.buffer
        if self._label(last) and self.buffer:
            if self.buffer.strip() or not last:
                yield "effect", self.buffer
            self.buffer = ""


def split_replies(deltas: DataFrame) -> DataFrame:
    """stream_id, seq, kind, text: parts of replies that arrive as (stream_id, seq, delta, last), kept per stream as state."""
    ship(deltas.sparkSession)

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer, phase, fresh, opening, seq = state.get if state.exists else ("", "keywords", True, False, 0)
        splitter, out, done = ReplySplitter(buffer=buffer, phase=phase, fresh=fresh, opening=opening), [], False
        rows = pd.concat(list(parts)).sort_values("seq")
        for delta, last in zip(rows["delta"], rows["last"]):
            for kind, text in splitter.feed(delta or "", bool(last)):
                out.append((key[0], seq, kind, text))
                seq += 1
            done = done or bool(last)
        if done:
            state.remove()
        else:
            state.update((splitter.buffer, splitter.phase, splitter.fresh, splitter.opening, seq))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "kind", "text"])

    return deltas.groupBy("stream_id").applyInPandasWithState(run, "stream_id long, seq int, kind string, text string", "buffer string, phase string, fresh boolean, opening boolean, seq int", "append", GroupStateTimeout.NoTimeout)


def run_dispatcher(ticks: DataFrame, items, now: Column, sink):
    """A foreachBatch query: at each tick recover stale items, choose what to send, and report job states to sink(name, frame)."""

    def tick(batch: DataFrame, number: int) -> None:
        current = recover_stale(items(batch.sparkSession), now)
        sink("dispatch", dispatch(current))
        sink("completion", completion(current))

    return ticks.writeStream.foreachBatch(tick)
