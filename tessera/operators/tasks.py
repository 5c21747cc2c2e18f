"""Research tasks: admission, the fold of their events, the latest one."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import progress

ACTIVE = ("QUEUED", "RUNNING")
LEASE, SPAN, MOST = "15 minutes", 60, 3
LEASE_SECONDS = 15 * 60
# What a task's status may become; a status that is no key here is final. A task begins as QUEUED.
NEXT = {"QUEUED": ("RUNNING", "FAILED"), "RUNNING": ("SUCCEEDED", "FAILED")}


def leased(tasks: DataFrame, now: Column, lease: str = LEASE) -> DataFrame:
    """Users with an active task that was updated within the lease: they may not start another."""
    return tasks.where(F.col("status").isin(*ACTIVE) & (F.col("updatedAt") >= now - F.expr(f"interval {lease}"))).select("userId").distinct()


def over_limit(requests: DataFrame, user: str, at: str, span: int = SPAN, most: int = MOST) -> DataFrame:
    """Requests by which the user has made `most` or more within the last `span` seconds, on whole seconds since the epoch.

    Time is cut into pieces of `span` seconds, and a frame runs within a user's piece and the one before it, whose requests come
    along: a user of very many requests is spread over the pieces."""
    rows = requests.withColumn("__s", F.unix_timestamp(at)).withColumn("__own", F.floor(F.col("__s") / span))
    rows = rows.withColumn("__piece", F.explode(F.array(F.col("__own"), F.col("__own") + 1)))
    w = Window.partitionBy(user, "__piece").orderBy("__s").rangeBetween(-span, 0)
    return rows.withColumn("recent", F.count("*").over(w)).where((F.col("__piece") == F.col("__own")) & (F.col("recent") >= most)).drop("__s", "__own", "__piece")


def of_user(tasks: DataFrame, task: object, user: object, succeeded: bool = False) -> DataFrame:
    """The task, if it is the user's; for an import it must have succeeded. All conditions reach the scan."""
    own = tasks.where((F.col("id") == F.lit(task)) & (F.col("userId") == F.lit(user)))
    return own.where("status = 'SUCCEEDED'") if succeeded else own


def latest(tasks: DataFrame, by: str, at: str, tie: str) -> DataFrame:
    """Each group's newest row. A partial maximum runs before the shuffle."""
    whole = F.struct(*tasks.columns)
    return tasks.groupBy(by).agg(F.max_by(whole, F.struct(at, tie)).alias("x")).select("x.*")


def task_states(events: DataFrame) -> DataFrame:
    """(taskId, status, progress): the last event of each task."""
    return events.groupBy("taskId").agg(F.max_by(F.struct("status", "progress"), F.struct("at", "seq")).alias("x")).select("taskId", "x.status", progress(F.col("x.progress")).alias("progress"))


def folded(state: tuple | None, events: list[tuple]) -> tuple:
    """(status, progress, time of the last event taken) after events (at, seq, status, progress) in their order, from such a state or, if None, from the beginning."""
    status, progress, last = state or ("QUEUED", 0, 0)
    for at, _, new, n in events:
        if status not in NEXT or (new != status and new not in NEXT[status]):
            continue  # nothing follows a final state, and no step is left out or taken back
        status, last = new, at
        progress = max(progress, min(100, n)) if status in NEXT else 100
    return status, progress, last


def task_progress(events: DataFrame) -> DataFrame:
    """(taskId, status, progress): each task's state machine, run over its events by (at, seq). A task is QUEUED, then RUNNING, then SUCCEEDED or FAILED; it can fail before
    it runs; other steps do not count. Progress never falls, and is 100 at the end.

    No task's events are gathered: the first event of each kind tells which count, so it is two groupings of partial sums."""
    rows = events.where("at is not null").select("taskId", "status", F.coalesce("progress", F.lit(0)).alias("progress"), F.struct("at", F.coalesce("seq", F.lit(0)).alias("seq"), "status").alias("k"))
    first = lambda status, also=True: F.min(F.when((F.col("status") == status) & also, F.col("k")))
    known = rows.groupBy("taskId").agg(first("RUNNING").alias("ran"), first("FAILED").alias("failed"))
    known = known.withColumn("ran", F.when(F.col("failed").isNull() | (F.col("ran") < F.col("failed")), F.col("ran")))
    both = rows.join(known.withColumnRenamed("taskId", "of"), F.col("taskId").eqNullSafe(F.col("of")))
    counts = (F.col("status") == "RUNNING") | ((F.col("status") == "QUEUED") & (F.col("ran").isNull() | (F.col("k") < F.col("ran"))))
    out = both.groupBy("taskId").agg(F.first("ran").alias("ran"), F.first("failed").alias("failed"), first("SUCCEEDED", F.col("k") > F.col("ran")).alias("done"), F.max(F.when(counts, progress(F.col("progress")))).alias("progress"))
    done, failed = F.col("done"), F.col("failed")
    status = F.when(done.isNotNull() & (failed.isNull() | (done < failed)), "SUCCEEDED").when(failed.isNotNull(), "FAILED").when(F.col("ran").isNotNull(), "RUNNING").otherwise("QUEUED")
    return out.select("taskId", status.alias("status"), F.when(status.isin(*NEXT), F.coalesce("progress", F.lit(0))).otherwise(100).cast("int").alias("progress"))


def search_calls(output: Column) -> tuple[Column, Column]:
    """(number of web search calls in a response's output, sum of their sources). output: array<struct<type,sources:array>>."""
    calls = F.filter(output, lambda o: o["type"] == "web_search_call")
    return F.size(calls), F.aggregate(calls, F.lit(0), lambda n, o: n + F.coalesce(F.size(o["sources"]), F.lit(0)))
