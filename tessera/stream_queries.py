"""Queries of task state machines, leases and admission over the events table, as batch and as stream, and the same in SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalogue_tables as T
from .catalogue_queries import register
from .operators import tasks
from .sources import folders
from .streaming import stateful

STATUSES = ("QUEUED", "RUNNING", "RUNNING", "RUNNING", "RUNNING", "SUCCEEDED", "FAILED", "unheard of")

# A fold of each user's events in their order, event by event.
PROGRESS_SQL = """
WITH e AS (SELECT user_id AS "taskId", [{statuses}][(event_id * 5 % 8)::INT + 1] AS status, (event_id * 13 % 140 - 10)::INT AS n, ts, event_id FROM events),
seq AS (SELECT "taskId", list({{'s': status, 'p': n}} ORDER BY ts, event_id) AS events FROM e GROUP BY 1),
fold AS (SELECT "taskId", list_reduce(list_concat([{{'s': 'QUEUED', 'p': 0::INT}}], events), lambda x, y:
  CASE WHEN x.s = 'QUEUED' AND y.s IN ('QUEUED', 'RUNNING') OR x.s = 'RUNNING' AND y.s = 'RUNNING' THEN {{'s': y.s, 'p': greatest(x.p, least(100, y.p))}}
    WHEN x.s = 'QUEUED' AND y.s = 'FAILED' OR x.s = 'RUNNING' AND y.s IN ('SUCCEEDED', 'FAILED') THEN {{'s': y.s, 'p': 100::INT}} ELSE x END) AS r FROM seq)
SELECT "taskId", r.s AS status, r.p AS progress FROM fold""".format(statuses=", ".join(f"'{s}'" for s in STATUSES))


def task_events(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (k * 5 % 8 + 1).cast("int"))
    return events.select(F.col("user_id").alias("taskId"), status.alias("status"), (k * 13 % 140 - 10).cast("int").alias("progress"), F.col("ts").cast("timestamp").alias("at"), k.alias("seq"))


def streamed(spark, d) -> DataFrame:
    schema = T.load(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


def last_told(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what there is; (batch, its rows) of all micro-batches, from a table of the shared folder."""
    spark, folder = stream.sparkSession, folders.fresh(stream.sparkSession, name)
    put = lambda rows, n: rows.withColumn("batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/rows/n={n}")  # noqa: E731  a batch that is run again takes its own place
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema.add("batch", "long")).parquet(f"{folder}/rows")


@register("task_progress", PROGRESS_SQL)
def task_progress(spark, d):
    """Each task's state machine over its events."""
    return tasks.task_progress(task_events(T.load(spark, d, "events")))


@register("task_progress_stream", PROGRESS_SQL)
def task_progress_stream(spark, d):
    """The same, kept as state by a stream."""
    stateful.prepare(spark)
    told = last_told(stateful.task_progress(task_events(streamed(spark, d))), "update", "progress")
    return told.groupBy("taskId").agg(F.max_by(F.struct("status", "progress"), "batch").alias("x")).select("taskId", "x.*")


@register("lease_stream", """
WITH e AS (SELECT user_id % 50 AS u, user_id AS t, max_by(event_id % 3 = 0, (ts, event_id)) AS done, max(ts) AS seen FROM events GROUP BY 1, 2),
now AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM events)
SELECT u AS "userId", bool_or(NOT done AND seen >= now - INTERVAL 15 MINUTE) AS leased FROM e, now GROUP BY 1 HAVING leased""")
def lease_stream(spark, d):
    """Users who hold a lease once the stream has seen all events, by the watermark's clock."""
    stateful.prepare(spark)
    k = F.col("event_id")
    rows = streamed(spark, d).select((F.col("user_id") % 50).alias("userId"), F.col("user_id").alias("taskId"), F.when(k % 3 == 0, "SUCCEEDED").otherwise("RUNNING").alias("status"), F.col("ts").cast("timestamp").alias("at"), k.alias("seq"))
    told = last_told(stateful.leases(rows, "1 day"), "update", "leases")
    return told.groupBy("userId").agg(F.max_by("leased", "batch").alias("leased")).where("leased")
