"""Operator 6: approximate nearest neighbours on shifted space-filling curves.

Each of CURVES curves projects the vectors on DIMS random directions, shifts the grid by a random amount and orders the
vectors by their Hilbert key. Keys are range-partitioned; each vector's position on a curve is its partition's offset and
its place there. A query meets the vectors at most `window` positions from its own, curve by curve, in blocks of BLOCK
positions; each block reranks them by exact distance, and the best of all blocks and curves are merged. Only vectors of the window
are compared: queries go in groups of neighbours on the curve, each with the slice of the block that its windows cover.

The window is WINDOW of all different vectors (LEAST_WINDOW at least): on vectors without any cluster structure, as the
driver's are, a fixed window loses recall as the table grows, and this share holds it above 0.9 at every size (tests and
README have figures). All curves together then compare a query with about as many vectors as there are: no index saves work on
such vectors. Clustered tables can do with far less, so the window is a parameter, a share or (above 1) a number of positions.

Vectors equal in every component form one class; one of each class is on the curves, and its eleven least ids stand for
it in results, which is all that ten neighbours can need. Defined results: vectors that are null, zero, hold a null or
non-finite component, or differ in length from most (ties: the shorter) take no part, nor do null ids. A repeated row
counts once; an id with two vectors is a candidate with both. Equal distances go to the smaller id. An empty table gives an
empty result. The grid's scale is fitted on the SAMPLE vectors of least hash.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

CURVES, DIMS, BITS = 24, 8, 7
WINDOW, LEAST_WINDOW = 0.02, 64
BLOCK = 4096
BLOCKS = 256  #: most blocks of a curve: larger tables have larger blocks, so that a query of all blocks is copied so often at most
GROUP = 16  #: queries compared at once
SAMPLE = 4096
SEED = 11


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys of integer cells [n, dims] below 2**bits, by the transposed form of Skilling (2004)."""
    x = cells.T.astype(np.int64)
    top = 1 << bits - 1
    q = top
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0]) ^ swap
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b & 1)
    return key


def directions(dim: int, curve: int) -> tuple[np.ndarray, np.ndarray]:
    """The orthonormal directions [dim, k] of a curve and its shift of the grid."""
    rng = np.random.default_rng([SEED, curve])
    k = min(DIMS, dim)
    return np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :k], rng.uniform(-0.12, 0.12, k)


def valid(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v, h1, h2) of the rows that take part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0).cast(x_type(vectors, vector))).otherwise(x))  # -0.0 equals 0.0
    return rows.where(F.size("v") == F.lit(size[0] if size else 0)).withColumn("h1", F.xxhash64(plain)).withColumn("h2", F.xxhash64(F.lit(5), plain))


def x_type(vectors: DataFrame, vector: str) -> T.DataType:
    return vectors.schema[vector].dataType.elementType


def search(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector: str = "embedding", window: float = WINDOW, curves: int = CURVES) -> DataFrame:
    """query_id, rank (from 1), id, score (Euclidean distance in doubles): the k nearest found of each row for which is_query(id column) holds. One curve with a window
    of 1.0 compares each query with every vector, block by block: an exact search."""
    spark = vectors.sparkSession
    rows = valid(vectors, id_col, vector)
    kind = np.float32 if isinstance(x_type(vectors, vector), T.FloatType) else np.float64
    reps = common.cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("low"), F.min_by("v", "id").alias("v"), F.max(is_query(F.col("id")).cast("int")).alias("asks")).withColumn("rep", F.monotonically_increasing_id()))
    total = reps.count()
    members = rows.select("h1", "h2", "id").distinct()
    least = Window.partitionBy("h1", "h2").orderBy("id")
    members = members.withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1).drop("n").join(reps.select("h1", "h2", "rep"), ["h1", "h2"]).select("rep", "id")
    sample = [r.v for r in reps.orderBy("h1", "h2").select("v").limit(SAMPLE).collect()]
    dim = len(sample[0]) if sample else 1
    width = max(LEAST_WINDOW, int(np.ceil(window * total))) if window <= 1 else int(window)
    grids = []
    for c in range(curves):
        to, shift = directions(dim, c)
        seen = np.array(sample, np.float64).reshape(-1, dim) @ to
        grids.append((to, seen.mean(0) if sample else 0.0, np.maximum(seen.std(0), 1e-12) if sample else 1.0, shift))
    sent = spark.sparkContext.broadcast(grids)

    def key(batches):
        for batch in batches:
            n = len(batch)
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, dim)
            for c, (to, mean, scale, shift) in enumerate(sent.value):
                cells = np.clip((((x @ to - mean) / scale / 6 + 0.5 + shift) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(n, c, np.int32)), pa.array(hilbert(cells, BITS))], names=["rep", "curve", "key"])

    keys = common.arrow(reps.select("rep", "v"), key, "rep long, curve int, key long")
    dealt = keys.repartitionByRange("curve", "key", "rep").sortWithinPartitions("curve", "key", "rep")
    dealt = common.cut(dealt.select("rep", "curve", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("at")))
    parts = dealt.groupBy("curve", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = dealt.join(parts, ["curve", "part"]).select("rep", "curve", (F.col("base") + F.col("at") - F.col("first")).alias("pos"))
    placed = placed.join(reps.select("rep", "low", "v", "asks"), "rep")
    block = lambda p: F.floor(p / max(BLOCK, -(-total // BLOCKS)))
    data = placed.select("curve", block(F.col("pos")).alias("block"), F.lit(0).alias("asks"), "pos", "rep", "low", "v")
    asked = placed.where("asks = 1").withColumn("block", F.explode(F.sequence(block(F.greatest(F.lit(0), F.col("pos") - width)), block(F.least(F.lit(max(total - 1, 0)), F.col("pos") + width)))))
    units = data.unionByName(asked.select("curve", "block", F.lit(1).alias("asks"), "pos", "rep", "low", "v"))

    def near(batches):
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held)
            asks, pos, rep, low = (t.column(c).to_numpy() for c in ("asks", "pos", "rep", "low"))
            x = np.array(t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), kind).astype(np.float64).reshape(len(t), dim)
            n = int(np.searchsorted(asks, 1))  # vectors of the block come first, both they and the queries by position
            cand, at, ids, lows = x[:n], pos[:n], rep[:n], low[:n]
            squares = (cand**2).sum(1)
            out = [[], [], []]
            for lo in range(n, len(t), GROUP) if n else ():
                q = np.arange(lo, min(lo + GROUP, len(t)))
                begin, end = np.searchsorted(at, pos[q[0]] - width), np.searchsorted(at, pos[q[-1]] + width, "right")
                rough = squares[begin:end] - 2 * x[q] @ cand[begin:end].T
                rough[np.abs(at[None, begin:end] - pos[q][:, None]) > width] = np.inf
                m = min(k + 1, end - begin)
                if m <= 0:
                    continue
                worst = np.partition(rough, m - 1, axis=1)[:, m - 1]
                for row, i in enumerate(q.tolist()):
                    # all that are as near as the m-th, but for rounding; then the m of least exact distance, ties by the class's least id
                    b = begin + np.flatnonzero((rough[row] <= worst[row] + 1e-9 * (squares[begin:end].max() + x[i] @ x[i])) & np.isfinite(rough[row]))
                    d = np.sqrt(((cand[b] - x[i]) ** 2).sum(1))
                    first = np.lexsort((lows[b], d))[:m]
                    out[0] += [rep[i]] * len(first)
                    out[1] += ids[b[first]].tolist()
                    out[2] += d[first].tolist()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["q", "rep", "d"])

        for batch in batches:
            if not len(batch):
                continue
            both = batch.column(0).to_numpy().astype(np.int64) << 40 | batch.column(1).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(both)) + 1).tolist(), len(batch)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                if held and (held[0].column(0)[0], held[0].column(1)[0]) != (part.column(0)[0], part.column(1)[0]):
                    yield done()
                    held.clear()
                held.append(part)
        if held:
            yield done()

    found = common.arrow(units.repartition("curve", "block").sortWithinPartitions("curve", "block", "asks", "pos"), near, "q long, rep long, d double")
    found = found.groupBy("q", "rep").agg(F.min("d").alias("d")).join(members, "rep")  # the classes found, with the ids that stand for them
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy("d", "id"))).where(F.col("n") <= k + 1).select("q", "d", "id")
    asking = rows.where(is_query(F.col("id"))).select("h1", "h2", F.col("id").alias("query_id")).distinct().join(reps.select("h1", "h2", F.col("rep").alias("q")), ["h1", "h2"]).select("q", "query_id")
    near_ids = asking.join(best, "q").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return near_ids.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", F.col("d").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    found = search(common.table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0)
    return found.withColumnRenamed("id", "vec_id")
