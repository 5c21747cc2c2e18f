"""Operator 13: conversation prefix trie.

Every turn has a digest of its role and text, every prefix of a conversation the digest of the chain of these, so equal
prefixes meet by (depth, digest) whatever their texts' length. The chain is made in two or more levels, as a long conversation
must not be one task's work: within segments of SEGMENT turns, and over the segments' last digests in the same way. Nodes are groups
of prefixes. A node's line is the part of the trie below it of the same least member, so every node lies on one line.

For sums over subtrees each node is exploded to its ancestors, but not node by node: along a line nodes with a single child on
the line form a stretch that ends where the trie forks or the line does. A stretch, with its sum, is exploded to the stretches above it, and
sums within a stretch are running sums along the line. Each stretch but the first of a line begins at a fork where
another line begins at the same depth, so there are at most twice as many rows as turns, even for long conversations that are
copies of each other (all nodes to all ancestors would be the square of their length).

Ordinals of turns come from a range partitioning by conversation and turn, running sums from slices, and the ids that end at a node
are hashed from pieces of PIECE ids, so neither a long conversation nor one that is often repeated is held in one task.

Defined results: a null role or text counts as empty; turns are ordered by turn, null first, then by role and text; repeated
rows are turns of their own. Rows of null conv_id take no part. A conversation without turns (after rebuilding) is a member of the root only.
An empty table gives an empty result. Other columns are ignored.
"""

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, mixing

SEGMENT = 64  #: turns, or digests of segments, chained in one group
SLICE = 4096  #: depths of a line in one window partition
PIECE = 4096  #: ids in one piece of a node's list
BLOCK, HEADS = 20, 4  #: conversations that share beginnings, and how many lengths these have


def sha(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def placed(rows: DataFrame, *order: Column) -> DataFrame:
    """rows in order over all partitions, with __part and __at, which rise along it; a hot key is spread over partitions. Written, as another run may cut elsewhere."""
    own = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return own.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id())


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, digest, words): k is a turn's place in its conversation, from 1."""
    body = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *body)
    rows = placed(rows, F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"))
    digest = sha(F.concat(sha(F.col("role").cast("binary")), sha(F.col("text").cast("binary"))))
    own = common.cut(rows.select("conv_id", "__part", "__at", digest.alias("digest"), mixing.size_of(F.col("text")).alias("words")))
    parts = own.groupBy("conv_id", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("conv_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per partition that holds a part of the conversation
    parts = common.cut(parts.select("conv_id", "__part", (before - F.col("__first") + 1).alias("__add")))
    return own.join(parts, ["conv_id", "__part"]).select("conv_id", (F.col("__at") + F.col("__add")).alias("k"), "digest", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth, n_turns, digest, words) and conversations (conv_id, n_turns), each begun with the first h turns of the first of its block."""
    counts = common.cut(turns.groupBy("conv_id").agg(F.max("k").alias("n_own")))
    head = F.when(F.col("conv_id") % BLOCK == 0, F.lit(0)).otherwise(F.crc32(F.col("conv_id").cast("string")) % HEADS)
    convs = counts.select("conv_id", "n_own", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("src"), head.alias("h"))
    convs = convs.join(counts.select(F.col("conv_id").alias("src"), F.least("n_own", F.lit(HEADS - 1)).alias("n_src")), "src", "left")
    lent = F.least("h", F.coalesce("n_src", F.lit(0)))
    convs = common.cut(convs.select("conv_id", "src", "h", lent.alias("lent"), (lent + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).alias("n_turns")))
    own = turns.join(convs, "conv_id").where("k > h").select("conv_id", (F.col("lent") + F.col("k") - F.col("h")).alias("depth"), "n_turns", "digest", "words")
    heads = turns.where(F.col("k") < HEADS).select(F.col("conv_id").alias("src"), "k", "digest", "words")
    begun = convs.where("lent > 0").join(heads, "src").where("k <= lent").select("conv_id", F.col("k").alias("depth"), "n_turns", "digest", "words")
    return own.unionByName(begun), convs.select("conv_id", "n_turns")


def chained(rows: DataFrame, most: int, *also: str) -> DataFrame:
    """rows (conv_id, at from 0, digest, also) with the digest of the chain up to there in place of their own. most: no `at` is greater."""
    item = F.struct("at", "digest", *also)
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    segments = rows.groupBy("conv_id", F.expr(f"at div {SEGMENT}").alias("seg")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    link = lambda acc, e: F.concat(acc, F.array(sha(F.concat(F.coalesce(last(acc), F.lit(b"")), e["digest"]))))
    segments = segments.withColumn("chain", F.aggregate("x", F.array().cast("array<binary>"), link))
    before = F.lit(b"")
    if most >= SEGMENT:
        segments = common.cut(segments)
        upto = chained(segments.select("conv_id", F.col("seg").alias("at"), last(F.col("chain")).alias("digest")), most // SEGMENT)
        segments = segments.join(upto.select("conv_id", (F.col("at") + 1).alias("seg"), F.col("digest").alias("before")), ["conv_id", "seg"], "left")
        before = F.coalesce("before", before)
    one = F.explode(F.arrays_zip("x", "chain")).alias("e")
    return segments.select("conv_id", before.alias("before"), one).select("conv_id", "e.x.at", sha(F.concat("before", "e.chain")).alias("digest"), *[F.col(f"e.x.{c}") for c in also])


def running(rows: DataFrame, deepest: int, *sums: str) -> DataFrame:
    """rows (rep, depth, ...) with each of sums added up along the line, this row in; windows hold SLICE depths."""
    rows = rows.withColumn("__slice", F.expr(f"depth div {SLICE}"))
    within = Window.partitionBy("rep", "__slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"{c}_upto": F.sum(c).over(within) for c in sums})
    if deepest >= SLICE:
        so_far = Window.partitionBy("rep").orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
        slices = rows.groupBy("rep", "__slice").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
        slices = common.cut(slices.select("rep", "__slice", *[F.coalesce(F.sum(f"__{c}").over(so_far), F.lit(0)).alias(f"__{c}") for c in sums]))
        out = out.join(slices, ["rep", "__slice"]).withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"__{c}") for c in sums})
    return out.drop("__slice", *[f"__{c}" for c in sums])


def ends_of(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256) from (depth, digest, conv_id): the hash of each node's ids, ascending and comma-joined."""
    rows = common.cut(placed(ends, F.asc("depth"), F.asc("digest"), F.asc("conv_id")))
    pieces = rows.groupBy("depth", "digest", "__part", F.expr(f"__at div {PIECE}").alias("piece")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    pieces = pieces.select("depth", "digest", "__part", "piece", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches):
        key, sha256 = None, None

        def told(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.binary()), pa.array([d[2] for d in done], pa.string())], names=["depth", "digest", "ends_sha256"])

        for batch in batches:
            done = []
            for depth, digest, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "digest", "ids")), strict=True):
                if (depth, digest) != key:
                    if key:
                        done.append((*key, sha256.hexdigest()))
                    key, sha256 = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    sha256.update(f",{ids}".encode())
            yield told(done)
        yield told([(*key, sha256.hexdigest())] if key else [])

    dealt = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "__part", "piece")
    return common.arrow(dealt, run, "depth long, digest binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(common.cut(turns_of(conversations)))
    convs = common.cut(convs)
    # a first member of no conversation stands for an empty table, which has no node
    first, n_all, deepest = convs.agg(F.coalesce(F.min("conv_id"), F.lit(0)), F.count("*"), F.coalesce(F.max("n_turns"), F.lit(0))).first()
    rows = chained(turns.withColumn("at", F.col("depth") - 1), deepest - 1, "words", "n_turns")
    prefixes = common.cut(rows.select("conv_id", (F.col("at") + 1).alias("depth"), "digest", "words", "n_turns"))
    groups = common.cut(prefixes.groupBy("depth", "digest").agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs")))

    # the prefixes of conversations that are the least member of a node; those of a node's own line are the nodes
    lines = groups.select(F.col("rep").alias("conv_id")).distinct()
    paths = prefixes.join(lines, "conv_id", "left_semi").join(groups, ["depth", "digest"]).select("conv_id", "depth", "digest", "words", "n_turns", "rep", "n_convs")
    root = convs.join(lines.union(lines.sparkSession.range(first, first + 1).toDF("conv_id")).distinct(), "conv_id", "left_semi")
    root = root.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), F.lit(0).cast("long").alias("words"), "n_turns", F.lit(first).cast("long").alias("rep"), F.lit(n_all).cast("long").alias("n_convs"))
    paths = common.cut(paths.unionByName(root))
    nodes = paths.where("conv_id = rep").drop("conv_id")
    starts = nodes.groupBy("rep").agg(F.min("depth").alias("depth")).where("depth > 0")
    above = paths.select(F.col("conv_id").alias("of"), F.col("depth").alias("up"), F.col("rep").alias("parent"))
    starts = common.cut(starts.join(above, (F.col("rep") == F.col("of")) & (F.col("depth") - 1 == F.col("up"))).select("rep", "depth", "parent"))
    kids = starts.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("rep")).agg(F.count("*").alias("kids"))

    # stretches: `ends` counts the last nodes of stretches along the line
    nodes = nodes.join(kids, ["rep", "depth"], "left").withColumn("n_children", F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("n_turns")).cast("int"))
    nodes = nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("words")).withColumn("ends", ((F.col("n_children") != 1) | (F.col("depth") == F.col("n_turns"))).cast("int"))
    nodes = running(nodes.select("rep", "depth", "digest", "n_convs", "n_children", "own", "ends"), deepest, "own", "ends")
    nodes = common.cut(nodes.withColumn("stretch", F.col("ends_upto") - F.col("ends")))
    stretches = nodes.groupBy("rep", "stretch").agg(F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("own").alias("own"), F.max("own_upto").alias("own_upto"), F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"))
    stretches = common.cut(stretches)
    forks = paths.join(nodes.where("ends = 1 and n_children > 0").select("rep", "depth"), ["rep", "depth"]).select("conv_id", F.col("rep").alias("of"), F.col("depth").alias("at"))
    below = stretches.select(F.col("rep").alias("conv_id"), "top", "own", "leaves").join(forks, "conv_id").where("at < top")
    below = below.groupBy(F.col("of").alias("rep"), F.col("at").alias("bottom")).agg(F.sum("own").alias("own_below"), F.sum("leaves").alias("leaves_below"))
    sums = stretches.join(below, ["rep", "bottom"], "left").select("rep", "stretch", "own_upto", F.coalesce("own_below", F.lit(0)).alias("own_below"), (F.col("leaves") + F.coalesce("leaves_below", F.lit(0))).alias("n_leaves"))
    sums = common.cut(sums.withColumnRenamed("own_upto", "own_end"))
    out = nodes.join(sums, ["rep", "stretch"]).join(starts, ["rep", "depth"], "left")

    turnless = convs.where("n_turns = 0").select(F.lit(0).cast("long").alias("depth"), F.lit(b"").alias("digest"), "conv_id")
    ends = ends_of(prefixes.where("depth = n_turns").select("depth", "digest", "conv_id").unionByName(turnless))
    out = out.join(ends, ["depth", "digest"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "rep"))
    saved = F.col("own_end") - F.col("own_upto") + F.col("own") + F.col("own_below")
    return out.select(F.col("rep").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", F.col("n_children").cast("long").alias("n_children"), F.col("n_leaves").cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(common.table(spark, sf_dir, "conversations"))


# crc32 bit by bit, as for op10's rows
ORACLE_SQL = r"""
WITH turn AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
conv AS (SELECT conv_id, conv_id - conv_id % 20 AS src, CASE WHEN conv_id % 20 = 0 THEN 0 ELSE xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda s, b: xor(xor(s, b) >> 1, (xor(s, b) & 1) * 3988292384)), 4294967295::BIGINT) % 4 END AS h FROM (SELECT DISTINCT conv_id FROM turn)),
part AS (SELECT c.conv_id, 0 AS p, k, role, text FROM conv c JOIN turn t ON t.conv_id = c.src AND t.k <= c.h UNION ALL SELECT c.conv_id, 1, k, role, text FROM conv c JOIN turn t ON t.conv_id = c.conv_id AND t.k > c.h),
seq AS (SELECT conv_id, list(sha256(role) || sha256(text) ORDER BY p, k) AS s, list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT ORDER BY p, k) AS w FROM part GROUP BY conv_id),
every AS (SELECT conv_id, coalesce(s, []) AS s, coalesce(w, []) AS w FROM conv LEFT JOIN seq USING (conv_id)),
prefix AS (SELECT conv_id, d, sha256(array_to_string(s[1:d], ',')) AS key, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words, d = len(s) AS whole FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM every)),
node AS (SELECT d, key, min(conv_id) AS rep, count(*) AS n, any_value(words) AS words, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (whole) AS ends FROM prefix GROUP BY d, key),
up AS (SELECT n.d, n.key, n.rep, p.key AS parent_key, q.rep AS parent FROM node n LEFT JOIN prefix p ON p.conv_id = n.rep AND p.d = n.d - 1 LEFT JOIN node q ON q.d = p.d AND q.key = p.key),
kids AS (SELECT d - 1 AS d, parent_key AS key, count(*) AS kids FROM up WHERE parent_key IS NOT NULL GROUP BY ALL),
told AS (SELECT node.*, up.parent, coalesce(kids, 0) AS kids FROM node JOIN up USING (d, key) LEFT JOIN kids USING (d, key)),
below AS (SELECT p.d, p.key, sum((t.n - 1) * t.words)::BIGINT AS saved, count(*) FILTER (t.kids = 0) AS leaves FROM told t JOIN prefix p ON p.conv_id = t.rep AND p.d <= t.d GROUP BY ALL)
SELECT rep AS conv_id, d::BIGINT AS depth, parent AS parent_conv_id, n AS n_convs, kids::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM told JOIN below USING (d, key)"""
