"""The task operators over streams: requests over the limit, counts of requests in sliding spans, and task states folded by event time."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.tasks import MOST, SPAN


def over_limit(requests: DataFrame, user: str, at: str, span: int = SPAN, most: int = MOST, late: str = "5 minutes") -> DataFrame:
    """(user, at, recent): requests by which a user has made `most` or more within the last `span` seconds, as the batch operator counts them.

    The state of a user is the seconds of the last `span` and whatever the watermark still lets come; a request counts those at or
    before its own second that have arrived up to its micro-batch. For the append output mode."""
    kind = requests.schema[user].dataType.simpleString()

    def count(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        new = pd.concat(list(batches))["__s"].sort_values()
        seen = pd.concat([pd.Series(list(state.get[0]) if state.exists else [], dtype="int64"), new]).sort_values().to_numpy()
        recent = seen.searchsorted(new, "right") - seen.searchsorted(new - span, "left")
        watermark = state.getCurrentWatermarkMs() // 1000
        kept = seen[seen >= min(int(seen[-1]), watermark if watermark > 0 else int(seen[0])) - span]
        state.update((kept.tolist(),))
        state.setTimeoutTimestamp(max(int(seen[-1]) + span + 1, watermark + 1) * 1000)
        hit = recent >= most
        yield pd.DataFrame({user: [key[0]] * int(hit.sum()), at: pd.to_datetime(new[hit], unit="s", utc=True), "recent": recent[hit]})

    rows = requests.withWatermark(at, late).withColumn("__s", F.unix_timestamp(at))
    return rows.groupBy(user).applyInPandasWithState(count, f"`{user}` {kind}, `{at}` timestamp, recent long", "seconds array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def request_counts(requests: DataFrame, user: str, at: str, span: str = "60 seconds", slide: str = "10 seconds", late: str = "5 minutes", most: int = MOST) -> DataFrame:
    """(user, window, n): sliding spans, not each request's own last seconds as over_limit takes them, in which a user made `most` requests or more. State is dropped once the watermark has passed a span."""
    counts = requests.withWatermark(at, late).groupBy(F.window(at, span, slide), user).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= most)


def task_states(events: DataFrame, at: str = "at") -> DataFrame:
    """(taskId, status, progress) of the newest event so far; for the update or complete output mode."""
    return events.groupBy("taskId").agg(F.max_by(F.struct("status", "progress"), F.struct(at, "seq")).alias("x")).select("taskId", "x.status", "x.progress")
