"""Operator 9: mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule has the point frac(i * golden ratio) (multiplicative form on 32 bits, the points of every further 2^31
slots shifted), which the cumulative target shares map to a source. Slots are ranked within their source; rank r takes block r
mod n of the source's n equal-token blocks, cut from its documents in the order of a seeded hash. A source takes no slots beyond
its quota, and one whose points did not fill its quota gets the rest at the end.

Target weights: sources by code point, null last, weigh 3, 1, 2, repeating; they share 150 % of all words; a target
stops at twice its source's words and the excess goes to the others by weight, again until none is above.
Sources may be as many as documents: they are numbered in range partitions, their quotas added up in slices, and each round of
the sharing is one aggregation over them.

Defined results: null text has 0 words, a document without words is taken 0 times, null source is a source of its
own. Documents of equal hash are ordered by id and size; full repeats are interchangeable. An empty table gives an
empty result. Window functions run within (source, slice), slices holding about SLICE rows whatever a source's share.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
SHARE = 1.5  #: words taken, of all words
MOST = 2.0  #: times that a source, and so a document, can be taken
BLOCK_WORDS = 256  #: words in a block of a large source
LEAST_BLOCKS = 128  #: blocks of a source that has that many words
SLICE = 8192  #: rows that one window partition is meant to hold
CELLS = 4096  #: cells of the unit interval by which points meet sources
SEED = 17


def size_of(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def numbered(src: DataFrame) -> DataFrame:
    """src with source_no, from 0 by code point, null last: the place in its range partition and the rows of the partitions before."""
    order = F.asc_nulls_last("source")
    own = src.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    own = common.cut(own)
    parts = own.groupBy("__part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))  # a row per partition
    before = F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return own.join(F.broadcast(parts.select("__part", "__first", before.alias("__before"))), "__part").withColumn("source_no", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before")


def level_of(src: DataFrame) -> float:
    """The words per weight at which the targets, each at most `most`, share SHARE of all words; infinite if all are at most. Each round is one aggregation."""
    share, weight = src.agg(F.sum("source_size") * F.lit(SHARE), F.sum("w")).first()
    level, last = (share or 0.0) / (weight or 1.0), -1.0
    while last < level < float("inf"):
        above = F.col("most") < level * F.col("w")
        full, rest = src.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        last, level = level, (share - full) / rest if rest else float("inf")
    return max(last, level)


def sources_of(sized: DataFrame) -> DataFrame:
    """One row per source: source, source_no, source_size, n_docs, target, n_blocks, quota (slots)."""
    src = numbered(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    src = src.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("source_no") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    src = common.cut(src.withColumn("most", F.col("source_size") * F.lit(MOST)))
    src = src.withColumn("target", F.least("most", F.lit(level_of(src)) * F.col("w")))
    src = src.withColumn("n_blocks", F.least(F.col("source_size"), F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS))).cast("long"))
    src = src.withColumn("quota", F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("n_blocks") / F.greatest(F.col("source_size"), F.lit(1))), F.col("n_blocks") * F.lit(MOST)).cast("long")).otherwise(F.lit(0)).cast("long"))
    return src.select("source", "source_no", "source_size", "n_docs", "target", "n_blocks", "quota")


def running(src: DataFrame, value: str) -> DataFrame:
    """src with `upto`, the sum of value over the sources up to this one: slices of SLICE sources, and a row per slice."""
    rows = src.withColumn("__slice", F.floor(F.col("source_no") / SLICE))
    sums = rows.groupBy("__slice").agg(F.sum(value).alias("__n"))
    sums = sums.select("__slice", F.coalesce(F.sum("__n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    within = F.sum(value).over(Window.partitionBy("__slice").orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("upto", within).join(sums, "__slice").withColumn("upto", F.col("upto") + F.col("__base")).drop("__slice", "__base")


def placed(sized: DataFrame, src: DataFrame) -> DataFrame:
    """sized with source_no and [start, end), each document's words in its source's shuffled order. Sums run within slices of a source; slice sums join them."""
    rows = sized.join(src.select(F.col("source").alias("s"), "source_no", "source_size", "n_docs", "target", "n_blocks"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    rows = rows.withColumn("key", F.xxhash64(F.lit(SEED), "doc_id")).withColumn("slice", F.pmod(F.col("key"), F.greatest(F.lit(1), F.ceil(F.col("n_docs") / SLICE)).cast("long")))
    sums = rows.groupBy("source_no", "slice").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    within = Window.partitionBy("source_no", "slice").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(sums, ["source_no", "slice"])
    return rows.withColumn("end", F.col("base") + F.col("upto")).withColumn("start", F.col("end") - F.col("size")).drop("key", "slice", "base", "upto", "n_docs")


def schedule(src: DataFrame) -> DataFrame:
    """(slot, source_no, epoch, block): which block of which source each slot takes; slots are in the order of training."""
    spark = src.sparkSession
    total, n_sources = src.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    n = int(total * 1.02) + 64 * 16 if total else 0  # most sources reach their quota a little after the end of an ideal schedule
    cells, whole = max(CELLS, 4 * n_sources), F.lit(float(max(total, 1)))
    spans = running(src, "quota").where("quota > 0").withColumn("hi", F.col("upto") / whole).withColumn("lo", (F.col("upto") - F.col("quota")) / whole)
    spans = spans.select("source_no", "quota", "n_blocks", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    point = F.pmod(F.pmod("slot", F.lit(1 << 31)) * F.lit(2654435769), F.lit(1 << 32)) / F.lit(float(1 << 32))
    shift = F.pmod(F.floor(F.col("slot") / F.lit(1 << 31)) * F.lit(0.7548776662466927), F.lit(1.0))
    slots = spark.range(n).withColumnRenamed("id", "slot").withColumn("x", F.pmod(point + shift, F.lit(1.0)))
    slots = slots.withColumn("cell", F.floor(F.col("x") * cells)).join(spans, "cell").where("lo <= x and x < hi").select("slot", "source_no", "quota", "n_blocks", F.floor(F.col("slot") / SLICE).alias("slice"))
    counts = common.cut(slots.groupBy("source_no", "slice").agg(F.count("*").alias("c")))
    base = counts.withColumn("base", F.coalesce(F.sum("c").over(Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("c")
    rank = F.col("base") + F.row_number().over(Window.partitionBy("source_no", "slice").orderBy("slot")) - 1
    ranked = slots.join(base, ["source_no", "slice"]).withColumn("rank", rank).where("rank < quota").select("slot", "source_no", "n_blocks", "rank")
    got = counts.groupBy("source_no").agg(F.sum("c").alias("got"))
    short = src.join(got, "source_no", "left").withColumn("got", F.least("quota", F.coalesce("got", F.lit(0)))).withColumn("lacking", F.col("quota") - F.col("got"))
    short = running(short, "lacking").where("lacking > 0").select(F.lit(n).alias("n"), "upto", "lacking", "source_no", "n_blocks", F.posexplode(F.sequence(F.col("got"), F.col("quota") - 1)).alias("i", "rank"))
    ranked = ranked.unionByName(short.select((F.col("n") + F.col("upto") - F.col("lacking") + F.col("i")).alias("slot"), "source_no", "n_blocks", "rank"))
    return ranked.select("slot", "source_no", F.floor(F.col("rank") / F.col("n_blocks")).alias("epoch"), (F.col("rank") % F.col("n_blocks")).alias("block"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target (its source's), taken (words the mix takes, repeats counted)."""
    sized = common.cut(docs.select(F.col(id_col).alias("doc_id"), F.col(source).cast("string").alias("source"), size_of(F.col(text)).alias("size")))
    src = common.cut(sources_of(sized))
    rows = common.cut(placed(sized, src))
    times = schedule(src).groupBy("source_no", "block").agg(F.count("*").alias("times"))
    small, longer = F.expr("source_size div n_blocks"), F.expr("source_size % n_blocks")  # the first `longer` blocks have a word more
    block = lambda p: F.when(p < longer * (small + 1), F.expr("0") + F.floor(p / (small + 1))).otherwise(longer + F.floor((p - longer * (small + 1)) / small))
    begin = lambda j: j * small + F.least(j, longer)
    parts = rows.where("size > 0").withColumn("block", F.explode(F.sequence(block(F.col("start")), block(F.col("end") - 1))))
    parts = parts.withColumn("words", F.least("end", begin(F.col("block") + 1)) - F.greatest("start", begin(F.col("block"))))
    taken = parts.join(times, ["source_no", "block"]).groupBy("source_no", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    # a document with words is alone in having its start; one without has no row here
    key = F.when(F.col("size") > 0, F.col("start"))
    out = rows.withColumn("k", key).join(taken.withColumnRenamed("start", "k"), ["source_no", "k"], "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded: 0, 1 or 2 rows."""
    names = docs.columns
    key = F.struct("doc_id", F.xxhash64(*[F.col(c) for c in names]).alias("h"))
    taken = mix(docs.select(key.alias("k"), "source", "text"), "k")
    total = taken.groupBy("doc_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = total.select(F.col("doc_id").alias("__k"), F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(1).cast("int").alias("__times"))
    rows = docs.withColumn("__own", key).join(times, F.col("__own").eqNullSafe(F.col("__k"))).where("__times > 0")
    return rows.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*names)
