"""Stateful streams against their batch forms, micro-batch by micro-batch."""

import datetime
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import tasks
from tessera.streaming import stateful

START = datetime.datetime(2024, 5, 1, 12)


def at(seconds):
    return START + datetime.timedelta(seconds=seconds)


class Feed:
    """A stream of files, one at a time, and what comes out, by micro-batch."""

    def __init__(self, spark, tmp_path, schema, build, mode):
        stateful.prepare(spark)
        self.spark, self.schema, self.folder, self.out, self.n = spark, schema, str(tmp_path / "in"), [], 0
        spark.createDataFrame([], schema).write.parquet(self.folder)
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(self.folder)
        take = lambda df, _: self.out.append(df.collect())
        self.query = build(rows).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(take).start()

    def give(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.folder)
        self.query.processAllAvailable()
        return [r for part in self.out for r in part]


@pytest.fixture
def feed(spark, tmp_path):
    made = []

    def start(schema, build, mode):
        made.append(Feed(spark, tmp_path, schema, build, mode))
        return made[0]

    yield start
    made[0].query.stop()


EVENTS = "taskId string, status string, progress int, at timestamp, seq long"


def test_folded():
    step = lambda *events: tasks.folded(None, [(i, 0, s, p) for i, (s, p) in enumerate(events)])[:2]
    assert step(("QUEUED", 5), ("RUNNING", 15), ("RUNNING", 10), ("SUCCEEDED", 3), ("RUNNING", 20)) == ("SUCCEEDED", 100)
    assert step(("SUCCEEDED", 100), ("RUNNING", 140)) == ("RUNNING", 100) and step(("FAILED", 1), ("RUNNING", 2)) == ("FAILED", 100)
    assert step(("RUNNING", 15), ("QUEUED", 90)) == ("RUNNING", 15) and step(("x", 50)) == ("QUEUED", 0) and step() == ("QUEUED", 0)


def test_task_progress_stream(spark, feed):
    """Out-of-order events over three micro-batches, some behind the watermark's folded part of another: equal to the batch at each end."""
    rng = random.Random(5)
    events = [(f"t{i % 12}", rng.choice(["QUEUED", "RUNNING", "RUNNING", "SUCCEEDED", "FAILED", "x"]), rng.randint(-5, 120), at(40 * i), i % 3) for i in range(120)]
    late = sorted(events, key=lambda e: (e[3] - START).total_seconds() + rng.uniform(0, 500))  # at most 500 s out of order, 600 are waited for
    stream = feed(EVENTS, stateful.task_progress, "update")
    for i in range(3):
        now = {r.taskId: (r.status, r.progress) for r in stream.give(late[40 * i : 40 * i + 40])}
        so_far = spark.createDataFrame(late[: 40 * i + 40], EVENTS)
        assert now == {r.taskId: (r.status, r.progress) for r in tasks.task_progress(so_far).collect()}
    assert {s for s, _ in now.values()} == {"SUCCEEDED", "FAILED"} or len({s for s, _ in now.values()}) > 1
    plain = {}
    for e in sorted(events, key=lambda e: (e[3], e[4], e[1])):
        plain.setdefault(e[0], []).append((e[3], e[4], e[1], e[2]))
    assert now == {t: tasks.folded(None, of)[:2] for t, of in plain.items()}


def test_task_progress_with_odd_rows(spark):
    rows = [("a", None, None, at(1), None), ("a", "RUNNING", None, at(2), 1), ("b", "RUNNING", 5, None, 1), (None, "QUEUED", 7, at(1), 1)]
    got = {r.taskId: (r.status, r.progress) for r in tasks.task_progress(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {"a": ("RUNNING", 0), None: ("QUEUED", 7)}
    assert tasks.task_progress(spark.createDataFrame([], EVENTS)).count() == 0


def test_leases_stream(spark, feed):
    """After each micro-batch the same users hold a lease as in the batch; without events leases end by the timer."""
    schema = "userId string, taskId string, status string, at timestamp, seq long"
    stream, rows, told = feed(schema, stateful.leases, "update"), [], {}
    batches = [
        [("u", "1", "RUNNING", at(0), 1), ("v", "2", "QUEUED", at(10), 1), ("w", "3", "RUNNING", at(0), 1), ("w", "3", "SUCCEEDED", at(20), 2)],
        [("u", "1", "RUNNING", at(600), 2), ("x", "9", "QUEUED", at(961), 1)],  # v's lease has ended on the clock, 900 s after 10
        [("v", "4", "RUNNING", at(1000), 1), ("w", "3", "RUNNING", at(962), 1), ("x", "9", "FAILED", at(965), 2), ("y", "5", "x", at(1700), 1)],
        [("z", "6", "QUEUED", at(5000), 1)],
    ]
    for batch in batches:
        rows += batch
        told.update({r.userId: r.leased for r in stream.give(batch)})
        newest = tasks.latest(spark.createDataFrame(rows, schema), "taskId", "at", "seq").withColumnRenamed("at", "updatedAt")
        now = max(r[3] for r in rows) - datetime.timedelta(minutes=1)
        assert {u for u, x in told.items() if x} == {r.userId for r in tasks.leased(newest, F.lit(now)).collect()}
    assert told["u"] is False and told["v"] is False and told["z"] is True


def admitted(events):
    """One user's requests by the rules, event by event."""
    active, made, out = {}, [], []
    for seconds, task, status in events:
        active = {k: t for k, t in active.items() if t + 900 >= seconds}
        if status == "REQUESTED":
            why = "LEASED" if active else "LIMITED" if sum(m >= seconds - 60 for m in made) >= 3 else None
            if why is None:
                made.append(seconds)
                active[task] = seconds
            out.append((task, why))
        elif status in ("QUEUED", "RUNNING"):
            active[task] = seconds
        else:
            active.pop(task, None)
    return out


def test_admission_stream(spark, feed):
    """Lease and limit over three micro-batches: done tasks free their user, silent ones after 15 minutes, and a fourth request within a minute waits."""
    events = [(0, "a", "REQUESTED"), (5, "b", "REQUESTED"), (6, "a", "SUCCEEDED"), (10, "c", "REQUESTED"), (12, "c", "FAILED"), (20, "d", "REQUESTED"), (21, "d", "FAILED"), (30, "e", "REQUESTED"), (80, "f", "REQUESTED"), (85, "f", "RUNNING"), (500, "g", "REQUESTED"), (985, "h", "REQUESTED"), (986, "i", "REQUESTED"), (3000, "j", "REQUESTED"), (3901, "k", "REQUESTED")]
    stream = feed("userId string, taskId string, status string, at timestamp, seq long", stateful.admissions, "append")
    for part in (events[:6], events[6:11], events[11:]):
        got = stream.give([(u, t, s, at(x), 1) for u in ("u", "v") for x, t, s in part])
    for user in ("u", "v"):
        assert [(r.taskId, r.reason) for r in sorted(got, key=lambda r: r["at"]) if r.userId == user] == admitted(events)
    assert {r.reason for r in got} == {None, "LEASED", "LIMITED"} and all(r.admitted == (r.reason is None) for r in got)


def test_lease_state_is_called_once_per_task():
    """A user's many events of few tasks: the state is read once, and written once for each task."""

    class Store:
        def __init__(self):
            self.rows, self.reads, self.writes = {}, 0, 0

        exists = lambda self: bool(self.rows)
        containsKey = lambda self, k: k in self.rows  # noqa: E731, N815

        def getValue(self, k):  # noqa: N802
            self.reads += 1
            return self.rows[k]

        def updateValue(self, k, v):  # noqa: N802
            self.writes += 1
            self.rows[k] = v

        def removeKey(self, k):  # noqa: N802
            del self.rows[k]

        def iterator(self):
            self.reads += 1
            return iter(list(self.rows.items()))

        def get(self):
            return self.rows["v"]

        def update(self, v):
            self.rows["v"] = v

        def clear(self):
            self.rows.clear()

    class Handle:
        getMapState = getValueState = lambda self, *a: Store()  # noqa: E731, N815
        listTimers = lambda self: []  # noqa: E731, N815
        deleteTimer = registerTimer = lambda self, at: None  # noqa: E731, N815

    class Clock:
        getCurrentWatermarkInMs = lambda self: self.ms  # noqa: E731, N815
        ms = 0

    lease, clock = stateful.Leases(), Clock()
    lease.init(Handle())
    n = 1000
    part = pd.DataFrame({"at": pd.to_datetime([i // 3 for i in range(n)], unit="s"), "seq": range(n), "taskId": [str(i % 7) for i in range(n)], "status": ["RUNNING" if i < n - 7 else "SUCCEEDED" if i % 7 else "RUNNING" for i in range(n)]})
    out = [x for rows in (part[::2], part[1::2]) for x in lease.handleInputRows((1,), iter([rows]), clock)]
    assert [x["leased"].tolist() for x in out] == [[True]] and lease.tasks.writes <= 14 and lease.tasks.reads <= 2
    assert {k[0]: v for k, v in lease.tasks.rows.items()} == {str(i % 7): (i // 3 * 1_000_000, i, i % 7 == 0) for i in range(n - 7, n)}
    clock.ms = 10_000_000
    out = list(lease.handleExpiredTimer((1,), clock, None))
    assert [x["leased"].tolist() for x in out] == [[False]] and not lease.tasks.rows
