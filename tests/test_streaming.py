"""Streams give the rows of their batch twins."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorespark.operators import cache
from lorespark.streaming import file_events, ordered, run, state

T0 = dt.datetime(2024, 1, 1)


def drained(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return q


def test_file_events(spark, tmp_path):
    rows = [
        (1, T0, "modified", "/f/a.py", None), (2, T0 + dt.timedelta(seconds=1), "modified", "/f/a.py", None), (3, T0 + dt.timedelta(seconds=30), "modified", "/f/a.py", None),
        (4, T0, "created", "/f/.git/x", None), (5, T0, "moved", "/f/.git/x", "/f/x.py"), (6, T0 + dt.timedelta(days=2), "created", "/f/z.py", None),
    ]
    events = spark.createDataFrame(rows, file_events.SCHEMA)
    events.write.json(str(tmp_path / "in"))
    batch = file_events.debounced(file_events.relevant(events))
    assert {(r.path, r.events) for r in batch.collect()} == {("/f/a.py", 2), ("/f/a.py", 1), ("/f/.git/x", 1), ("/f/z.py", 1)}
    drained(file_events.debounced(file_events.relevant(file_events.read_stream(spark, str(tmp_path / "in")))), "bursts")
    got = {(r.path, r.events) for r in spark.table("bursts").collect()}
    assert got == {("/f/a.py", 2), ("/f/a.py", 1), ("/f/.git/x", 1)}  # the last one waits for its watermark


def test_breaker(spark, tmp_path):
    s, open_ = (0, 0.0, False), []
    for at, failed in [(0, True), (1, True), (2, True), (3, False), (70, True), (71, False)]:
        s, blocked = state.breaker_step(s, at, failed, 3, 60)
        open_.append((s[2], blocked))
    assert open_ == [(False, False), (False, False), (True, False), (True, True), (False, False), (False, False)]
    assert state.breaker_step((3, 0.0, True), 1, True, 3, 0) == ((1, 1, False), False)
    rows = [(1, i, T0 + dt.timedelta(seconds=i), f) for i, f in enumerate([True, True, False, True])] + [(2, 9, T0, True)]
    calls = spark.createDataFrame(rows, "key long, call_id long, ts timestamp, failed boolean")
    named = calls.withColumnRenamed("call_id", "id")
    assert [(r.failures, r.open) for r in state.breaker_states(calls, 2).filter("key = 1").orderBy("call_id").collect()] == [(1, False), (2, True), (0, False), (1, False)]
    got = streamed(spark, named, str(tmp_path / "in"), lambda c: state.breaker_stream(c, 2, 0.5))
    assert [(r.blocked, r.open) for r in sorted(got, key=lambda r: r.id) if r.key == 1] == [(False, False), (False, True), (False, False), (False, False)]


def streamed(spark, calls, folder, query, files=1, **options):
    """The rows of a query over calls as a stream, a file in each micro-batch, closed at its end."""
    calls.repartition(files).write.parquet(folder)
    source = lambda: spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    stream, closer = run.closing(source())
    return run.finished(query(stream), "streamed", close=(closer, source())).collect()


@pytest.mark.parametrize(("rows", "files", "arrow"), [(30_000, 1, 10_000), (30_000, 5, 100), (600, 3, 1)])
def test_one_hot_key_in_any_batches(spark, tmp_path, rows, files, arrow):
    """Shuffled calls of one key, also with equal times, give the batch twin's rows and those of a plain loop."""
    r = random.Random(rows)
    calls = [(1, i, T0 + dt.timedelta(milliseconds=100 * r.randint(0, rows)), r.random() < 0.4) for i in range(rows)]
    now, want = (0, 0, False), {}
    for _, i, ts, failed in sorted(calls, key=lambda x: (x[2], x[1])):
        now, blocked = state.breaker_step(now, (ts - T0) // dt.timedelta(microseconds=1), failed, 3, 5_000_000)
        want[i] = (blocked, now[2])
    d = spark.createDataFrame(calls, "key long, id long, ts timestamp, failed boolean")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow))
        got = streamed(spark, d, str(tmp_path / "in"), lambda c: state.breaker_stream(c, 3, 5), files)
        batch = state.breaker_calls(d, 3, 5).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(batch) == rows
    assert {x.id: (x.blocked, x.open) for x in got} == {x.id: (x.blocked, x.open) for x in batch} == want


class Handle:
    """The state of one key, as a store would hold it."""

    def __init__(self):
        self.rows, self.value, self.timers = [], None, set()

    def getListState(self, *_):
        return self

    getValueState = lambda self, *_: Value(self)

    def appendList(self, rows):
        self.rows += rows

    def put(self, rows):
        self.rows = list(rows)

    def get(self):
        return iter(self.rows)

    def clear(self):
        self.rows = []

    def registerTimer(self, at):
        self.timers.add(at)


class Value:
    def __init__(self, of):
        self.of = of

    def get(self):
        return self.of.value

    def update(self, x):
        self.of.value = x

    def clear(self):
        self.of.value = None


def test_idle_keys_leave_nothing():
    """Once the watermark has passed what an entry lives, no state of the key is left."""
    handle = Handle()
    p = ordered.InOrder(state._cache(10, 128, 0.9), ["key", "id", "hit", "of", "similarity"])
    p.init(handle)
    rows = pd.DataFrame({"at": [5_000_000, 1_000_000, 40_000_000], "id": [2, 1, 3], "said": ['{"query": "a"}'] * 3})
    assert not list(p.handleInputRows(("k",), iter([rows]), None))
    watermark = type("T", (), {"getCurrentWatermarkInMs": lambda self: self.at})()
    seen = []
    for _ in range(20):
        due = sorted(t for t in handle.timers)
        if not due:
            break
        handle.timers.remove(due[0])
        watermark.at = due[0]
        for f in p.handleExpiredTimer(("k",), watermark, None):
            seen += f[["id", "hit"]].values.tolist()
    assert seen == [[1, False], [2, True], [3, False]] and handle.value is None and not handle.rows


def test_cache_entries():
    step = lambda entries, at, i, q, v=None, capacity=2: state.cache_step(entries, at * 1_000_000, i, q, v, 10, capacity, 0.9)
    e, got = step([], 0, 1, "a", [1.0, 0.0])
    assert got == (False, None, None)
    assert step(e, 1, 2, "b", [2.0, 0.1])[1] == (True, 1, 0.998752)
    assert step(e, 1, 2, "b", [1.0])[1][0] is False and step(e, 1, 2, "b", [0.0, 0.0])[1][0] is False and step(e, 1, 2, "b")[1][0] is False
    assert step(e, 11, 2, "b", [1.0, 0.0])[1][0] is False  # too old to be similar
    e, got = step(e, 11, 3, "a", [1.0, 0.0])
    assert got[0] is False and [x[1] for x in e] == [3]  # too old to be the same, and gone
    e, _ = step(e, 12, 4, "b", [0.0, 1.0])
    e, _ = step(e, 13, 5, "c", [-1.0, 0.0])
    assert [x[1] for x in e] == [4, 5]  # first in, first out


def test_cache_and_usage(spark, tmp_path):
    rows = [("q", i, t) for i, t in enumerate([0, 5, 11, 12, 30])] + [("r", 9, 3)]
    calls = spark.createDataFrame(rows, "query string, event_id long, stored_at long")
    want = {r.event_id: r.hit for r in cache.replayed(calls, 10).collect()}
    assert want == {0: False, 1: True, 2: False, 3: True, 4: False, 9: False}
    named = calls.select(F.col("query").alias("key"), F.col("event_id").alias("id"), F.timestamp_seconds(F.col("stored_at") + 10**9).alias("ts"), "query", F.lit(None).cast("array<double>").alias("vector"))
    assert {r.id: r.hit for r in streamed(spark, named, str(tmp_path / "in"), lambda c: state.cache_stream(c, 10))} == want
    assert {r.id: r.hit for r in state.cache_calls(named, 10).collect()} == want
    odd = named.unionByName(named.withColumn("id", F.lit(None).cast("long"))).unionByName(named.withColumn("ts", F.lit(None).cast("timestamp")))
    assert {r.id: r.hit for r in state.cache_calls(odd, 10).collect()} == want and state.cache_calls(named.limit(0), 10).count() == 0
    use = spark.createDataFrame([(1, 10, 1), (1, 5, 2), (2, 7, 0)], "session long, tokens_in long, tokens_out long")
    use.write.json(str(tmp_path / "use"))
    drained(state.usage_stream(spark.readStream.schema(use.schema).json(str(tmp_path / "use"))), "usage", "complete")
    assert {(r.session, r.prompt_tokens, r.completion_tokens) for r in spark.table("usage").select("session", "prompt_tokens", "completion_tokens").collect()} == {(1, 15, 3), (2, 7, 0)}


def test_daily_counts(spark):
    events = spark.createDataFrame([(1, T0, "created", "/a", None), (2, T0 + dt.timedelta(hours=25), "created", "/a", None)], file_events.SCHEMA)
    assert [r.events for r in file_events.daily_counts(events).collect()] == [1, 1]
    assert file_events.daily_counts(events.limit(0)).select(F.sum("events")).first()[0] is None


def test_waiting_rows_refer_to_vectors(spark, tmp_path):
    """Calls with repeated vectors, over several slots and micro-batches: the batch twin's rows; a vector leaves a task a few times only."""
    r = random.Random(5)
    vectors = [[r.gauss(0, 1) for _ in range(4)] for _ in range(9)] + [None, [], [1.0]]
    rows = [(i % 2, i, T0 + dt.timedelta(minutes=r.randint(0, 2000)), r.choice([None, "a", "b", f"w{i}"]), r.choice(vectors)) for i in range(1200)]
    calls = spark.createDataFrame(rows, "key long, id long, ts timestamp, query string, vector array<double>")
    want = {x.id: (x.hit, x.of, x.similarity) for x in state.cache_calls(calls, 3600, 8, 0.4).collect()}
    got = streamed(spark, calls, str(tmp_path / "in"), lambda c: state.cache_stream(c, 3600, 8, 0.4, "3 days"), 3)
    assert len(got) == 1200 and {x.id: (x.hit, x.of, x.similarity) for x in got} == want
    assert any(0.4 <= s < 1 for _, _, s in want.values() if s) and any(s == 1 for _, _, s in want.values())
    said = ordered._said(calls.coalesce(1).select("key", "id", "ts", "query", "vector"), "vector").withColumn("known", F.lit(True))
    sent = ordered._once(said).filter("vector is not null").collect()
    assert len(sent) == len({(x.key, x.of) for x in sent}) == 20
    last = {}
    for k, _, ts, _, v in rows:
        if v:
            last[k, str(v)] = max(last.get((k, str(v)), ts), ts)
    assert all(x.ts == last[x.key, str(x.vector)] for x in sent)  # no later row can be in time if the one with the vector is not
