"""Tables in buckets of a key that are changed in place and read by key.

A snapshot is a Parquet table partitioned by a bucket of its key's hash and sorted by the key within files, with bloom filters on the named columns and small row groups.
A read by key opens the files of one bucket and, by the footers' least and greatest keys and the bloom filters, few row groups of these. A change rewrites the
buckets that it touches and no other: the new rows are first written aside, then put in the place of the old partitions (dynamic partition overwrite), so a
change that fails halfway can be run again from the same rows. A key with very many rows is spread over several files of its bucket.

One change at a time: Parquet has no transactions, and readers of a bucket that is being replaced may fail.
"""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import written

BUCKET = "__bucket"
ROW_GROUP_BYTES = 1 << 20


@dataclass
class Change:
    """What a rewrite has done: the buckets, and the rows of the keys that it was about, as they were and as they are."""

    buckets: list[int]
    before: DataFrame
    after: DataFrame


@dataclass(frozen=True)
class Snapshot:
    path: str
    key: str
    blooms: tuple[str, ...] = ()
    buckets: int = 64

    def bucket(self, key: Column) -> Column:
        """Null keys have a bucket too."""
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = rows.hint("rebalance", BUCKET).sortWithinPartitions(BUCKET, self.key)
        out = dealt.write.mode(mode).partitionBy(BUCKET).option("partitionOverwriteMode", "dynamic").option("parquet.block.size", ROW_GROUP_BYTES)
        for c in self.blooms:
            out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
        out.parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Write rows as a new snapshot; there must be none at the path."""
        self._write(rows.withColumn(BUCKET, self.bucket(F.col(self.key))), "error")

    def _all(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._all(spark).drop(BUCKET)

    def at(self, spark: SparkSession, *keys: object) -> DataFrame:
        """The rows of some keys: their buckets alone are listed, and the keys reach the scan."""
        kind = self._all(spark).schema[self.key].dataType
        mine = [r[0] for r in spark.range(1).select(F.explode(F.array(*[self.bucket(F.lit(k).cast(kind)) for k in keys]))).distinct().collect()]
        return self._all(spark).where(F.col(BUCKET).isin(mine) & F.col(self.key).isin(list(keys))).drop(BUCKET)

    def rewrite(self, changes: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> Change:
        """merge(the old rows of the touched buckets, changes) takes the place of these rows. `changes` has the snapshot's key; merge must leave rows of other keys alone."""
        spark = changes.sparkSession
        keyed = changes.withColumn(BUCKET, self.bucket(F.col(self.key)))
        touched = sorted(r[0] for r in keyed.select(BUCKET).distinct().collect())  # `buckets` rows at most
        old = self._all(spark).where(F.col(BUCKET).isin(touched))
        keys = written(changes.select(F.col(self.key).alias("__key")).distinct(), "keys")
        mine = lambda rows: rows.join(keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_semi")
        before = written(mine(old.drop(BUCKET)), "before")
        new = written(merge(old.drop(BUCKET), changes).withColumn(BUCKET, self.bucket(F.col(self.key))), "rows")
        after = mine(new.drop(BUCKET))
        self._write(new, "overwrite")
        left = {r[0] for r in new.select(BUCKET).distinct().collect()}
        for b in set(touched) - left:  # an overwrite leaves a partition alone that gets no row
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{BUCKET}={b}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        return Change(touched, before, after)


def scanned_rows(rows: DataFrame) -> int:
    """Rows that the scans of an action's plan have read, behind the pruning of files and row groups. For tests."""
    rows.collect()
    plan, n = [rows._jdf.queryExecution().executedPlan()], 0
    while plan:
        p = plan.pop()
        if p.nodeName() == "AdaptiveSparkPlan":
            p = p.executedPlan()
        if p.nodeName().endswith("QueryStage"):
            p = p.plan()
        if p.nodeName().startswith("Scan parquet"):
            n += p.metrics().apply("numOutputRows").value()
        plan += [p.children().apply(i) for i in range(p.children().size())]
    return n
