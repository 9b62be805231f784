"""Bucket tables, the dispatcher's stream and item timers: files that stay, batches that run again, restarts."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from stackroom.sources.buckets import BucketTable
from stackroom.streaming import dispatcher, timers
from stackroom.streaming.dispatcher import Dispatcher

T0 = dt.datetime(2024, 1, 1)


def files(path):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_replace_touches_its_buckets_only(spark, tmp_path):
    path = f"{tmp_path}/t"
    rows = spark.createDataFrame([(f"b{i % 40}", i, "old") for i in range(200)], "book_id string, chunk_idx int, text string")
    table = BucketTable.create(rows, path, ("book_id",), buckets=16)
    before = files(path)
    new = spark.createDataFrame([("b3", 0, "new"), ("b3", 1, "new"), ("b99", 0, "first")], rows.schema)
    for _ in range(2):  # a second run changes nothing more
        table.replace(new)
        got = sorted(map(tuple, BucketTable.open(spark, path).read().collect()))
        assert got == sorted([(b, i, t) for b, i, t in map(tuple, rows.collect()) if b != "b3"] + list(map(tuple, new.collect())))
    after = files(path)
    touched = {r.bucket for r in table._dealt(new).select("bucket").distinct().collect()}
    stay = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert stay and all(after.get(f) == before[f] for f in stay)


def test_delete_empties_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(i, str(i)) for i in range(10)], "id long, x string")
    table = BucketTable.create(rows, f"{tmp_path}/t", ("id",), buckets=50)
    table.delete(rows.filter("id < 9").select("id"))
    assert [tuple(r) for r in table.read().collect()] == [(9, "9")]
    table.delete(rows)
    assert table.read().collect() == [] and BucketTable.create(rows.filter("false"), f"{tmp_path}/e", ("id",)).read().collect() == []


def transitions(n=400, seed=6):
    r = random.Random(seed)
    out = []
    for seq in range(n):
        status = r.choice(["pending", "dispatched", "running", "failed", "done"])
        out.append((r.randint(1, 60), 7, seq, T0 + dt.timedelta(seconds=90 * seq), status, r.choice([None, "extracted", "summarized"]), "llm_error" if status == "failed" else None, f"e{seq}" if status == "failed" else None))
    return out


def fold(rows):
    state = {}
    for i, job, seq, ts, status, stage, group, error in sorted(rows, key=lambda r: r[2]):
        s = state.setdefault(i, dict(stage=None, attempt=0, last_error=None, started_at=None, finished_at=None))
        s.update(status=status, job_id=job, seq=seq, updated_at=ts, stage=stage or s["stage"], error_group=group if status == "failed" else None)
        s["attempt"] += status == "failed"
        s["last_error"] = error if status == "failed" else s["last_error"]
        s["started_at"] = s["started_at"] or (ts if status == "running" else None)
        s["finished_at"] = ts if status == "done" else s["finished_at"]
    return {i: tuple(sorted(s.items())) for i, s in state.items()}


def as_dict(state):
    return {r.id: tuple(sorted((k, v) for k, v in r.asDict().items() if k not in ("id", "failed_seq", "staged_seq", "batch"))) for r in state.collect()}


def written_log(spark, path, rows, parts):
    for p in range(parts):
        spark.createDataFrame(rows[p::parts], dispatcher.LOG).coalesce(1).write.parquet(f"{path}/{p}")  # every file has all times


def test_dispatcher_goes_on_after_a_failure_in_the_middle(spark, tmp_path, monkeypatch):
    rows, now = transitions(), F.lit(T0 + dt.timedelta(days=30)).cast("timestamp_ntz")
    written_log(spark, f"{tmp_path}/log", rows, 3)
    first = Dispatcher(spark, f"{tmp_path}/log/*", f"{tmp_path}/d", now, buckets=8)
    whole = dispatcher.completion
    failing = {"left": 1}

    def fails(*a):  # after the state of the second batch is merged, before its decisions are written
        if first.state.read().agg(F.max("batch")).head()[0] == 1 and failing["left"]:
            failing["left"] -= 1
            raise RuntimeError("planned")
        return whole(*a)

    monkeypatch.setattr(dispatcher, "completion", fails)
    with pytest.raises(Exception, match="planned"):
        first.run()
    assert not os.path.exists(f"{tmp_path}/d/jobs/batch=1")
    second = Dispatcher(spark, f"{tmp_path}/log/*", f"{tmp_path}/d", now, buckets=8)
    assert as_dict(second.run()) == fold(rows)
    jobs = second.decided("jobs").head()
    waiting = sum(dict(s)["status"] in ("pending", "failed", "dispatched", "running") and dict(s)["attempt"] + (dict(s)["status"] in ("dispatched", "running")) < 3 for s in fold(rows).values())
    assert (jobs.in_flight, jobs.eligible) == (0, waiting)  # all in flight are stale by then
    assert second.decided("dispatch").count() == min(32, waiting)
    assert as_dict(second.run()) == fold(rows)  # nothing new in the log
    more = [(1, 7, 10_000, T0, "canceled", None, None, None), (999, 8, 1, T0, "pending", None, None, None)]
    spark.createDataFrame(more, dispatcher.LOG).coalesce(1).write.parquet(f"{tmp_path}/log/9")
    want = fold(rows + more)
    want[1] = tuple(sorted({**dict(want[1]), "finished_at": max(x for x in (dict(want[1])["finished_at"], T0) if x)}.items()))
    assert as_dict(second.run()) == want


def test_limits_of_jobs(spark):
    items = spark.createDataFrame([(i, i % 2, "running" if i < 4 else "pending", "pending", 0) for i in range(40)], "id long, job_id long, status string, stage string, attempt int")
    limits = spark.createDataFrame([(0, 5)], "job_id long, high_water long")
    got = dispatcher.dispatch(items, high_water=4, limits=limits).groupBy("job_id").count().collect()
    assert {(r.job_id, r["count"]) for r in got} == {(0, 3), (1, 2)}


def test_timers_fire_at_the_limit_and_are_taken_back(spark, tmp_path):
    s = dt.timedelta(seconds=1)
    log = "id long, seq long, ts timestamp_ntz, status string, stage string, error_group string, attempt long"
    one = [(1, 1, T0, "dispatched", None, None, None), (2, 1, T0, "running", "extracted", None, None), (3, 1, T0, "running", "pending", None, None), (4, 1, T0, "failed", "pending", "llm_error", None), (5, 1, T0, "running", "indexed", None, None)]
    two = [(2, 2, T0 + 1000 * s, "running", "extracted", None, None), (5, 2, T0 + 899 * s, "done", "finalized", None, None), (4, 0, T0 + 10 * s, "running", None, None, None), (None, None, T0 + 1801 * s, None, None, None, None)]
    three = [(None, None, T0 + 2200 * s, None, None, None, None)]
    four = [(None, None, T0 + 2201 * s, None, None, None, None)]

    def step(rows, n):
        spark.createDataFrame(rows, log).coalesce(1).write.parquet(f"{tmp_path}/log/{n}")
        stream = spark.readStream.schema(log).parquet(f"{tmp_path}/log/*")
        return {(r.id, r.status, r.error_group, r.attempt) for r in timers.current(timers.run_watched(stream, str(tmp_path), "0 seconds")).collect()}

    same = {(1, "dispatched", None, 0), (4, "failed", "llm_error", 1)}
    assert step(one, 1) == same | {(2, "running", None, 0), (3, "running", None, 0), (5, "running", None, 0)}
    assert step(two, 2) == same | {(2, "running", None, 0), (3, "failed", "stale", 1), (5, "done", None, 0)}
    assert step(three, 3) == same | {(2, "running", None, 0), (3, "failed", "stale", 1), (5, "done", None, 0)}  # exactly at the limit
    assert step(four, 4) == same | {(2, "failed", "stale", 1), (3, "failed", "stale", 1), (5, "done", None, 0)}


def test_figures_are_cut_once(spark, sf_dir, monkeypatch):
    """What replaces figures comes from the table, not from the pages again."""
    from stackroom import plans
    from stackroom.sources.buckets import BucketTable

    read, replace = [], BucketTable.replace
    monkeypatch.setattr(BucketTable, "replace", lambda self, rows: (read.extend(rows.inputFiles()), replace(self, rows)))
    plans.QUERIES["snk07_figures_replaced"](spark, sf_dir)
    assert read and not any("/documents.parquet" in f for f in read)


def test_new_items_make_few_calls_on_state():
    """Each call goes to the JVM and back: a new item reads and writes its state once, and sets a timer if it needs one."""
    calls = []

    class Handle:
        def __getattr__(self, name):
            return lambda *a: calls.append(name) or None

    processor = timers.ItemTimers(1000)
    processor.handle = processor.item = Handle()
    row = {"id": 1, "seq": 1, "status": "running", "error_group": None, "attempt": 0, "limit_ms": 5, "at_ms": 7}
    assert [r.status for r in processor.handleInputRows((1,), iter([row]), None)] == ["running"]
    assert calls == ["get", "update", "registerTimer"]


def test_items_of_a_cell_share_calls_on_state():
    """Neighbouring ids have one value of state and one timer, at the earliest moment among them."""
    calls, kept = [], {}

    class Handle:
        def get(self):
            calls.append("get")
            return kept.get("value")

        def update(self, value):
            calls.append("update")
            kept["value"] = value

        def registerTimer(self, at):
            calls.append(("register", at))

        def deleteTimer(self, at):
            calls.append(("delete", at))

    class Clock:
        def __init__(self, now):
            self.now = now

        def getCurrentWatermarkInMs(self):
            return self.now

    def row(i, seq, status, at):
        return {"id": i, "seq": seq, "status": status, "error_group": None, "attempt": None, "limit_ms": 5, "at_ms": at}

    processor = timers.ItemTimers(1000)
    processor.handle = processor.item = Handle()
    rows = [row(i, 1, "running", 100 - i) for i in range(50)] + [row(60, 1, "done", 10)]
    assert sorted(r.id for r in processor.handleInputRows((0,), iter(rows), None)) == [*range(50), 60]
    assert calls == ["get", "update", ("register", 57)]
    calls.clear()
    assert [r.status for r in processor.handleInputRows((0,), iter([row(49, 2, "pending", 60), row(48, 1, "done", 60)]), None)] == ["pending"]
    assert calls == ["get", "update", ("delete", 57), ("register", 58)]
    calls.clear()
    got = [(r.id, r.status, r.error_group, r.attempt, r.due) for r in processor.handleExpiredTimer((0,), Clock(60), None)]
    assert got == [(i, "failed", "stale", 1, True) for i in (46, 47, 48)] and calls == ["get", "update", ("register", 61)]
    calls.clear()
    assert len(list(processor.handleExpiredTimer((0,), Clock(1010), None))) == 46 and calls == ["get", "update"]
    assert processor._kept().keys() == set(range(50))  # the finished item's state is cleared


def test_timers_of_many_items_as_a_plain_loop_gives_them(spark, tmp_path):
    r, s = random.Random(5), dt.timedelta(seconds=1)
    log = "id long, seq long, ts timestamp_ntz, status string, stage string, error_group string, attempt long"
    ids = [0, 1, 2, 511, 512, 513, -1, -512, -513, (1 << 53) + 1, (1 << 53) + 2, (1 << 63) - 1, -(1 << 63)]
    statuses = ["pending", "dispatched", "running", "running", "failed", "done", "canceled", None]
    limits = {"extracted": 1200, "indexed": 900, None: 1800}
    state, seen = {}, set()
    for n in range(4):
        rows = []
        for place in r.sample(range(60), 25):  # some come later than others of the next batch
            status = r.choice(statuses)
            rows.append((r.choice(ids), (1 << 53) + n * 20 + place, T0 + (n * 3600 + r.randint(1, 3600)) * s, status, r.choice(list(limits)), r.choice(["llm_error", None]), r.choice([None, 3, (1 << 53) + 1])))
        rows += [rows[0], (None, None, T0 + (n * 3600 + 3600) * s, None, None, None, None)]
        spark.createDataFrame(rows, log).coalesce(1).write.parquet(f"{tmp_path}/log/{n}")
        got = timers.run_watched(spark.readStream.schema(log).parquet(f"{tmp_path}/log/*"), str(tmp_path), "0 seconds", 2).collect()
        for i, q, ts, status, stage, group, attempt in sorted((x for x in rows if x[0] is not None), key=lambda x: x[1]):
            old = state.get(i, (-1, None, None, 0, None))
            if q <= old[0]:
                continue
            group = group if status == "failed" else None
            attempt = attempt if attempt is not None else old[3] + (status == "failed")
            wait = {"dispatched": 14400, "running": limits[stage]}.get(status)
            end = ts + wait * s + dt.timedelta(milliseconds=1) if wait else ts + 7200 * s if status in ("done", "canceled") else None
            state[i] = (q, status, group, attempt, end)
            seen.add((i, q, status, group, attempt, False))
        clock = T0 + (n * 3600 + 3600) * s
        for i, (q, status, _, attempt, end) in list(state.items()):
            if end and end <= clock and status in ("dispatched", "running"):
                state[i] = (q, "failed", "stale", attempt + 1, None)
                seen.add((i, q, "failed", "stale", attempt + 1, True))
            elif end and end <= clock:
                del state[i]
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, seen))
    assert any(x[-1] for x in seen)


def test_odd_times_of_items(spark, tmp_path):
    """No time: no timer. Times that pandas doesn't know are taken like others."""
    log = "id long, seq long, ts timestamp_ntz, status string, stage string, error_group string, attempt long"
    rows = [(1, 1, T0, "running", None, None, None), (2, 1, None, "running", None, None, None), (3, 1, dt.datetime(3000, 1, 1), "running", None, None, None)]
    spark.createDataFrame(rows, log).coalesce(1).write.parquet(f"{tmp_path}/log/1")
    got = timers.current(timers.run_watched(spark.readStream.schema(log).parquet(f"{tmp_path}/log/*"), str(tmp_path), "0 seconds")).collect()
    assert {(r.id, r.status, r.attempt) for r in got} == {(1, "failed", 1), (2, "running", 0), (3, "running", 0)}
