"""Task states, leases and admission as stateful streams: state by key in the state store, event-time timers, bounded state.

RocksDB keeps the state (prepare()), as transformWithState asks for. Times are event times; rows behind the watermark are dropped by Spark.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.tasks import ACTIVE, LEASE_SECONDS, MOST, NEXT, SPAN, folded

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RETAIN_SECONDS = 7 * 86_400  #: that a finished task is remembered


def prepare(spark: SparkSession) -> None:
    """Let the session's streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def micros(at: pd.Series) -> list[int]:
    return at.astype("datetime64[us]").astype("int64").tolist()


class TaskFold(StatefulProcessor):
    """The state machine of a task. Events that may still be overtaken wait in a list, in the order of their times; those behind the watermark are folded into one value."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "status string, progress int, at long")
        self.waiting = handle.getListState("waiting", "at long, seq long, status string, progress int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        new = [r for part in rows for r in zip(micros(part["at"]), part["seq"].tolist(), part["status"].tolist(), part["progress"].tolist(), strict=True)]
        waiting = sorted([*map(tuple, self.waiting.get()), *new]) if self.waiting.exists() else sorted(new)
        state = tuple(self.settled.get()) if self.settled.exists() else None
        behind = timerValues.getCurrentWatermarkInMs() * 1000
        n = sum(e[0] < behind for e in waiting)
        if n:
            state = folded(state, waiting[:n])
            self.settled.update(state)
            if state[0] not in NEXT:  # finished
                self.handle.registerTimer(state[2] // 1000 + RETAIN_SECONDS * 1000)
        if waiting[n:]:
            self.waiting.put(waiting[n:])
        elif self.waiting.exists():
            self.waiting.clear()
        status, progress, _ = folded(state, waiting[n:])
        yield pd.DataFrame({"taskId": [key[0]], "status": [status], "progress": [progress]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.settled.clear()
        self.waiting.clear()
        return iter(())


def task_progress(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(taskId, status, progress) of each task that has new events: what operators.tasks.task_progress() gives for all its events so far. For the update output mode."""
    rows = events.where("at is not null").select("taskId", "at", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("status", F.lit("")).alias("status"), F.coalesce("progress", F.lit(0)).cast("int").alias("progress"))
    kind = events.schema["taskId"].dataType.simpleString()
    return rows.withWatermark("at", late).groupBy("taskId").transformWithStateInPandas(TaskFold(), f"taskId {kind}, status string, progress int", "Update", "EventTime")


class Admission(StatefulProcessor):
    """Requests of one user, against the lease of the user's tasks and the limit of new ones. State: the tasks that hold a lease, and the times of the last
    MOST admissions, both few. A lease that is not renewed ends by a timer."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.active = handle.getMapState("active", "taskId string", "until long")
        self.made = handle.getListState("made", "at long")

    def _expire(self, now: int) -> None:
        for k in [k for k, (until,) in list(self.active.iterator()) if until < now] if self.active.exists() else []:
            self.active.removeKey(k)

    def _timer(self) -> None:
        """One timer, at the end of the last lease."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        ends = [until for _, (until,) in self.active.iterator()] if self.active.exists() else []
        if ends:
            self.handle.registerTimer(max(ends) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        events = sorted(r for part in rows for r in zip(micros(part["at"]), part["seq"].tolist(), part["taskId"].tolist(), part["status"].tolist(), strict=True))
        made = [x for (x,) in self.made.get()] if self.made.exists() else []
        out = []
        for at, _, task, status in events:
            self._expire(at)
            if status == "REQUESTED":
                held = self.active.exists() and any(True for _ in self.active.keys())
                second = at // 1_000_000
                recent = sum(x >= second - SPAN for x in made)
                why = "LEASED" if held else "LIMITED" if recent >= MOST else None
                if why is None:
                    made = [*made, second][-MOST:]
                    self.active.updateValue((task,), (at + LEASE_SECONDS * 1_000_000,))
                out.append((key[0], task, pd.Timestamp(at, unit="us", tz="UTC"), why is None, why))
            elif status in ACTIVE:
                self.active.updateValue((task,), (at + LEASE_SECONDS * 1_000_000,))
            elif self.active.exists() and self.active.containsKey((task,)):
                self.active.removeKey((task,))
        if made:
            self.made.put([(x,) for x in made])
        self._timer()
        yield pd.DataFrame(out, columns=["userId", "taskId", "at", "admitted", "reason"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self._expire(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if self.active.exists() and not any(True for _ in self.active.keys()):
            self.active.clear()
        return iter(())


def admissions(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """(userId, taskId, at, admitted, reason) of each request, an event of status REQUESTED: refused as LEASED while the user has a task that was requested,
    QUEUED or RUNNING within the lease, and as LIMITED if MOST of the user's requests were admitted within SPAN seconds. Events of a micro-batch count in the
    order of their times; what an earlier micro-batch has decided stays. For the append output mode."""
    rows = events.where("at is not null and taskId is not null").select("userId", F.col("taskId").cast("string").alias("taskId"), "at", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("status", F.lit("")).alias("status"))
    kind = events.schema["userId"].dataType.simpleString()
    schema = f"userId {kind}, taskId string, at timestamp, admitted boolean, reason string"
    return rows.withWatermark("at", late).groupBy("userId").transformWithStateInPandas(Admission(), schema, "Append", "EventTime")


class Leases(StatefulProcessor):
    """Whether a user may not start another task: one has been active within the lease, on the watermark's clock."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getMapState("tasks", "taskId string", "at long, seq long, active boolean")
        self.told = handle.getValueState("told", "leased boolean")

    def _held(self) -> dict:
        return {k[0]: tuple(v) for k, v in self.tasks.iterator()} if self.tasks.exists() else {}

    def _now(self, key, watermark: int, held: dict, new: dict) -> Iterator[pd.DataFrame]:
        """Keep what is new, forget what the watermark has passed, set the next timer, and tell what has changed. The state is read once, and a task is written once
        however many events it has: each call to the state goes to another process."""
        lease, left, ends = LEASE_SECONDS * 1_000_000, [], []
        for task, (at, seq, active) in (held | new).items():
            if at + lease < watermark:
                if task in held:
                    self.tasks.removeKey((task,))
                continue
            if task in new:
                self.tasks.updateValue((task,), (at, seq, active))
            left.append(at)
            if active:
                ends.append(at + lease)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if left:
            self.handle.registerTimer((min(ends) if ends else max(left) + lease) // 1000 + 1)
        before = self.told.exists() and self.told.get()[0]
        if bool(ends) != before:
            yield pd.DataFrame({"userId": [key[0]], "leased": [bool(ends)]})
        if ends:
            self.told.update((True,))
        elif self.told.exists():
            self.told.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, new = self._held(), {}
        for part in rows:
            for at, seq, task, status in zip(micros(part["at"]), part["seq"].tolist(), part["taskId"].tolist(), part["status"].tolist(), strict=True):
                old = new.get(task) or held.get(task)
                if old is None or (at, seq) > (old[0], old[1]):
                    new[task] = (at, seq, status in ACTIVE)
        yield from self._now(key, timerValues.getCurrentWatermarkInMs() * 1000, held, new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._now(key, timerValues.getCurrentWatermarkInMs() * 1000, self._held(), {})


def leases(updates: DataFrame, late: str = "1 minute") -> DataFrame:
    """(userId, leased) whenever it changes, by updates (userId, taskId, status, at, seq) of tasks: true for the users of operators.tasks.leased(), with the
    watermark for `now`. A lease that is not renewed ends by a timer, without an event. For the update output mode."""
    rows = updates.where("at is not null and taskId is not null").select("userId", F.col("taskId").cast("string").alias("taskId"), "at", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("status", F.lit("")).alias("status"))
    kind = updates.schema["userId"].dataType.simpleString()
    return rows.withWatermark("at", late).groupBy("userId").transformWithStateInPandas(Leases(), f"userId {kind}, leased boolean", "Update", "EventTime")
