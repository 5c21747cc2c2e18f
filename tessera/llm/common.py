"""What several corpus operators share: cutting lineage, components of a graph, Arrow helpers."""

import contextlib
import contextvars
import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: list[str] = []
_written: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("written", default=None)


_state: dict = {}


def kept(operator: str, key, build=None):
    """What an operator keeps in a Python worker between tasks. Workers serve one operator after another, so it takes the place of what another kept."""
    if operator not in _state or _state[operator][0] != key:
        _state.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _state[operator] = (key, build() if build else None)
    return _state[operator][1]


BATCH_ROWS = 1000  #: rows of an Arrow batch; Spark's 10,000 are too many where rows are texts


def arrow(rows: DataFrame, run, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema), in batches fit for texts; a task gives back what Arrow has pooled. The session's batch size is lowered, never raised."""
    conf = rows.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)

    def task(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(task, schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only where that is unset, on one machine (tests), a folder of our own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("On a cluster spark.checkpoint.dir must name a folder that the driver and all executors share.")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="tessera-"))
    return _own_dir[0]


def cut(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: later stages then restart from these files, not from df's lineage."""
    path = f"{shared_dir(df.sparkSession)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (run := _written.get()) is not None:
        run.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def tables():
    """A list of the tables that cut() writes within; runs beside it, in other threads, have lists of their own. Tables written outside of any run stay, for whoever clears the shared folder."""
    mine: list[str] = []
    token = _written.set(mine)
    try:
        yield mine
    finally:
        _written.reset(token)


def sweep(spark: SparkSession, run: list[str], keep: int = 0) -> int:
    """Delete the tables of a run, but for the last `keep`, once no result that reads them is needed any more; how many went."""
    gone = run[: len(run) - keep]
    del run[: len(run) - keep]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): root is the smallest node of node's component, for every node that has an edge to another.

    Alternating large-star and small-star rounds (Kiveris et al., 2014); each round is joins and
    groupings only, and is written to the shared folder. A node of high degree is split by AQE's skew join.
    """
    e = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join has a shuffle of its own and a hub's neighbours can be split
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def by_bytes(lengths: np.ndarray, most: int):
    """Slices (lo, hi) of rows whose lengths sum to about `most`; a longer row comes alone."""
    lo, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if i > lo and total + n > most:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(lengths):
        yield lo, len(lengths)


def texts_of(column: pa.Array) -> list[str]:
    return ["" if x is None else x for x in column.to_pylist()]


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the rows' offsets in them; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] and len(column) else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
