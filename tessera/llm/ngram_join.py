"""Operator 1: n-gram Jaccard join with Bayesian candidate pruning.

Documents of equal shingle sets form one text class (128 bits of set hash). MinHash values of the classes are banded;
classes that share a band key are chained into clusters, and only classes of one cluster meet in tasks: there, MinHash values
are compared 16 at a time, a pair is dropped as soon as the posterior probability (uniform prior) that its similarity
reaches THRESHOLD is below TOLERANCE, and what is left is verified exactly on the shingle sets.

A cluster is dealt in one of two ways, whichever copies fewer texts. As a whole: to blocks, and each pair of blocks is a unit of its own, so a text is
copied as often as its cluster has blocks. Or by band: each band key that classes share is a group, dealt to blocks in the same way, so a text is copied for each
key that it shares with others; a pair is compared in the unit of the first band that it shares. The first suits clusters of near copies, the second large ones that are chained of texts
with little in common. A block holds some LEAST_TEXTS texts, or twice the root of its group's texts, and LEAST_SHINGLES to MOST_SHINGLES shingles, by a
root too: no task sees more than two blocks, and units are even. Within a unit of a whole cluster, too, only pairs that share a band are compared, unless most do.
Links are counted where they are found: pairs never become rows.

With BANDS bands of ROWS values a pair of similarity 0.8 shares no band with probability 5e-6; no bound on partners,
candidates or bucket sizes applies.

Shingles: SHINGLE words in a row of the lower-cased text, words being runs of letters, digits and underscores; a text of
fewer words is one shingle. Defined results: texts without a word (null and empty ones too) link with nothing, each has
n_links 0 and its own id as class. A null id takes part under no id: class_id is then the least id of its class, null if
none. Repeated rows are copies: each row gets a result. Rows of one id and several texts count as one document for
class_id, and each row has its own text's links. An empty table gives an empty result.
"""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
THRESHOLD = 0.8
ROWS, BANDS = 6, 40
TOLERANCE = 1e-6
STEP = 16
LEAST_TEXTS = 64  #: texts in a block of a cluster
LEAST_SHINGLES, MOST_SHINGLES = 50_000, 1_000_000  #: shingles in a block; two blocks of the most take some 50 MB
TASK_SHINGLES = 2_000_000  #: shingles that a task of units is meant to hold
SEED = 20240229

WORD = re.compile(r"\w+")
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power(n: int) -> np.ndarray:
    if not _powers or len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            _powers[:] = [np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1 << 12), np.uint64(0x100000001B3 | 1)).cumprod(dtype=np.uint64)])]
    return _powers[0]


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of text: a polynomial in its UTF-8 bytes, scrambled."""
    words = " ".join(WORD.findall(text.lower()))
    if not words:
        return np.zeros(0, np.uint64)
    data = np.frombuffer(words.encode("utf-8", "replace"), np.uint8)
    ends = np.append(np.flatnonzero(data == 32), len(data))
    starts = np.concatenate([[0], ends[:-1] + 1])
    sizes = ends - starts
    power = _power(int(sizes.max()))
    # position within its word, counted from the end
    back = np.repeat(ends, sizes + 1)[: len(data)] - 1 - np.arange(len(data))
    parts = (data.astype(np.uint64) + np.uint64(1)) * power[np.maximum(back, 0)]
    parts[ends[:-1]] = 0
    return mixed(np.add.reduceat(parts, starts) + sizes.astype(np.uint64) * MIX)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct shingle hashes of text."""
    w = word_hashes(text or "")
    if len(w) == 0:
        return w
    k = min(SHINGLE, len(w))
    out = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x2545F4914F6CDD1D) + w[i : i + len(out)]
    return np.unique(mixed(out + np.uint64(k)))


def _salts() -> np.ndarray:
    return np.random.default_rng(SEED).integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minhashes(sets: list[np.ndarray]) -> np.ndarray:
    """[set, hash]: the least 32-bit values of ROWS * BANDS hash functions over each set; sets are not empty."""
    salts, out = _salts(), np.zeros((len(sets), ROWS * BANDS), np.uint32)
    for lo, hi in common.by_bytes(np.array([len(s) for s in sets]), 16_384):
        every = np.concatenate(sets[lo:hi])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[lo : hi - 1]])]).astype(np.int64)
        room = np.empty_like(every)
        for j, a in enumerate(salts):
            np.multiply(every, a, out=room)
            out[lo:hi, j] = np.minimum.reduceat(room, starts) >> np.uint64(32)
    return out


def band_keys(values: np.ndarray) -> np.ndarray:
    """[set, band]: a 64-bit key of the band's number and values."""
    out = np.zeros((len(values), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(values), b + 1, np.uint64)
        for r in range(ROWS):
            key = mixed(key * MIX + values[:, b * ROWS + r])
        out[:, b] = key
    return out.view(np.int64)


def least_matches() -> list[tuple[int, int]]:
    """(n, m): a pair with fewer than m of the first n values equal is dropped.

    The posterior after m of n is a beta distribution, and P(similarity >= t) = P(Binomial(n + 1, t) <= m)."""
    out = []
    for n in range(STEP, ROWS * BANDS + 1, STEP):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * THRESHOLD**m * (1 - THRESHOLD) ** (n + 1 - m)
            if tail >= TOLERANCE:
                break
            m += 1
        out.append((n, m))
    return out


def signed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, body, k1, k2, n, bands): body is the text's hash; class key, number of shingles, band keys; n = 0 and no bands for texts without a word."""
    def run(batches):
        common.kept("ngram", None)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in common.by_bytes(np.array([len(t or "") for t in texts]), 4_000_000):
                sets = [shingles(t) for t in texts[lo:hi]]
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = [(int(np.bitwise_xor.reduce(s)), int(mixed(s ^ MIX).sum(dtype=np.uint64))) if len(s) else (0, 0) for s in sets]
                bands = [None] * len(sets)
                if some:
                    for i, k in zip(some, band_keys(minhashes([sets[i] for i in some])), strict=True):
                        bands[i] = k
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(2).slice(lo, hi - lo),
                        pa.array(np.array([k[0] for k in keys], np.uint64).view(np.int64)),
                        pa.array(np.array([k[1] for k in keys], np.uint64).view(np.int64)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc", "body", "k1", "k2", "n", "bands"],
                )

    return common.arrow(docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("body")), run, "doc long, body long, k1 long, k2 long, n long, bands array<long>")


def partners(keys: np.ndarray) -> list[np.ndarray] | None:
    """For each set the later ones that share a band key with it; None if these are so many that comparing all is less work."""
    n = len(keys)
    groups, pairs = [], 0
    for b in range(BANDS):
        order = np.argsort(keys[:, b], kind="stable")
        ends = np.append(np.flatnonzero(np.diff(keys[order, b])) + 1, n)
        starts = np.append(0, ends[:-1])
        for i in np.flatnonzero(ends - starts > 1).tolist():
            groups.append(order[starts[i] : ends[i]])
            pairs += len(groups[-1]) ** 2
        if pairs * 4 > n * n:
            return None
    later: list[list] = [[] for _ in range(n)]
    for g in groups:
        for i, x in enumerate(g.tolist()):
            later[x].append(g[i + 1 :])
    return [np.unique(np.concatenate(x)) if x else np.zeros(0, np.int64) for x in later]


def linked(sets: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None, key: int | None = None, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each set: the copies it is linked to, and the index of the least set that links lead to. side: only pairs of two sides count, unless it is None. key:
    all sets have this band key, and pairs that share an earlier band do not count. seen: gets how many pairs are compared."""
    n, bounds = len(sets), least_matches()
    values = minhashes(sets)
    keys = band_keys(values)
    before = keys[:, : int(np.flatnonzero(keys[0] == key)[0])] if key is not None else None
    near = partners(keys) if key is None else None
    sizes = np.array([len(s) for s in sets])
    vocabulary, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    links, root, mark = np.zeros(n, np.int64), list(range(n)), np.zeros(len(vocabulary), bool)

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(n - 1):
        others = np.arange(a + 1, n) if near is None else near[a]
        if side is not None:
            others = others[side[others] != side[a]]
        # a pair whose sizes alone rule the threshold out can have no link
        others = others[np.minimum(sizes[others], sizes[a]) >= THRESHOLD * np.maximum(sizes[others], sizes[a])]
        if seen is not None:
            seen.append(len(others))
        same, done = np.zeros(len(others), np.int64), 0
        for upto, least in bounds:
            if not len(others):
                break
            same += (values[others, done:upto] == values[a, done:upto]).sum(1)
            keep = same >= least
            if before is not None and not done:
                keep[keep] = ~(before[others[keep]] == before[a]).any(1)
            others, same, done = others[keep], same[keep], upto
        if not len(others):
            continue
        mark[ids[starts[a] : starts[a + 1]]] = True
        spans = sizes[others]
        at = np.repeat(starts[others] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
        common_n = np.add.reduceat(mark[ids[at]].astype(np.int64), np.concatenate([[0], np.cumsum(spans)[:-1]]))
        mark[ids[starts[a] : starts[a + 1]]] = False
        # exactly: common / (|a| + |b| - common) >= 0.8
        hits = others[common_n * 10 >= (sizes[a] + spans - common_n) * round(THRESHOLD * 10)]
        links[a] += copies[hits].sum()
        links[hits] += copies[a]
        for b in hits.tolist():
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return links, np.array([top(i) for i in range(n)], np.int64)


def blocks_of(m, s):
    """How many blocks a group of m texts and s shingles has."""
    texts_in = F.greatest(F.lit(LEAST_TEXTS), 2 * F.sqrt(m))
    shingles_in = F.least(F.lit(MOST_SHINGLES), F.greatest(F.lit(LEAST_SHINGLES), 64 * F.sqrt(s)))
    return F.ceil(F.greatest(m / texts_in, s / shingles_in)).cast("int")


def dealt(reps: DataFrame, shared: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (banded, group, s, blocks), which are clusters or band keys, and their members (banded, group, block, blocks, rep, one, k1, k2, copies).

    A cluster of several blocks is dealt by band if its texts have fewer copies so."""
    sums = (F.count("*").alias("m"), F.sum("n").alias("s"))
    sizes = common.cut(reps.select("rep", "n").join(clusters, "rep").groupBy("root").agg(*sums).withColumn("blocks", blocks_of(F.col("m"), F.col("s"))))
    in_large = clusters.join(sizes.where("blocks > 1").select("root"), "root")
    by_key = shared.join(in_large, "rep").join(reps.select("rep", "n"), "rep").groupBy("key", "root").agg(*sums)
    by_key = common.cut(by_key.withColumn("blocks", blocks_of(F.col("m"), F.col("s"))))
    copies = by_key.groupBy("root").agg(F.sum(F.col("m") * F.col("blocks")).alias("by_band"))
    sizes = sizes.join(copies, "root", "left").withColumn("banded", F.coalesce(F.col("by_band") < F.col("m") * F.col("blocks"), F.lit(False)))
    sizes = common.cut(sizes.select("root", "s", "blocks", "banded"))
    whole, banded = sizes.where("not banded"), sizes.where("banded").select("root")
    keyed = common.cut(by_key.join(banded, "root").select(F.col("key").alias("group"), "s", "blocks"))
    groups = whole.select(F.lit(False).alias("banded"), F.col("root").alias("group"), "s", "blocks").unionByName(keyed.select(F.lit(True).alias("banded"), "group", "s", "blocks"))
    placed = clusters.join(whole, "root").select(F.lit(False).alias("banded"), F.col("root").alias("group"), "blocks", "rep")
    placed = placed.unionByName(shared.join(keyed, F.col("key") == F.col("group")).select(F.lit(True).alias("banded"), "group", "blocks", "rep"))
    members = reps.select("rep", "one", "k1", "k2", "copies").join(placed, "rep")
    return groups, members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))


def join(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, class_id (least id of its connected group), n_links (other rows of similarity 0.8 or more), copies (rows of its shingle set)."""
    every = common.cut(signed(docs, id_col, text))
    some = every.where("n > 0")
    reps = common.cut(some.groupBy("k1", "k2").agg(F.min("doc").alias("least"), F.min(F.struct("doc", "body")).alias("one"), F.count("*").alias("copies"), F.first("n").alias("n"), F.min("bands").alias("bands")).withColumn("rep", F.xxhash64("k1", "k2")))
    keys = reps.select("rep", F.explode("bands").alias("key"))
    # written, so that the join has a shuffle of its own and a common band key can be split
    hubs = common.cut(keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("most")).where("hub < most").select("key", "hub"))
    shared = common.cut(keys.join(hubs, "key").select("rep", "hub", "key"))
    clusters = common.cut(common.connected_components(shared.select("rep", "hub"), "rep", "hub").withColumnRenamed("node", "rep"))
    groups, members = dealt(reps, shared, clusters)
    # units are dealt by number of tasks, since bytes do not tell what comparing costs
    work = groups.agg(F.coalesce(F.sum(F.col("s") * F.col("blocks")), F.lit(0))).first()[0]
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, min(20 * least, -(-work // TASK_SHINGLES)))
    # one row of each class brings its text; a copy of that row does no harm
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text)).alias("body"), F.col(text).alias("text"))
    units = members.join(texts, members["one.doc"].eqNullSafe(texts["doc"]) & (members["one.body"] == texts["body"]))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = units.withColumn("other", other).select("banded", "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("second"), "rep", "k1", "k2", "copies", "text")

    def run(batches):
        held: list = []

        def done():
            sets, rows = [], []
            for r in held:
                s = shingles(r[9])
                if len(s) and not (rows and rows[-1][5] == r[5]) and (int(np.bitwise_xor.reduce(s)), int(mixed(s ^ MIX).sum(dtype=np.uint64))) == (r[6] % (1 << 64), r[7] % (1 << 64)):
                    sets.append(s)
                    rows.append(r)
            if len(sets) < 2:
                return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["rep", "links", "to"])
            off = rows[0][2] != rows[0][3]
            links, to = linked(sets, np.array([r[8] for r in rows]), np.array([r[4] for r in rows]) if off else None, rows[0][1] if rows[0][0] else None)
            reps_here = np.array([r[5] for r in rows])
            hit = links > 0
            return pa.RecordBatch.from_arrays([pa.array(reps_here[hit]), pa.array(links[hit]), pa.array(reps_here[to[hit]])], names=["rep", "links", "to"])

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][:4] != r[:4]:
                    yield done()
                    held.clear()
                held.append(r)
        if held:
            yield done()

    found = common.cut(common.arrow(units.repartition(tasks, "banded", "group", "i", "j").sortWithinPartitions("banded", "group", "i", "j", "rep"), run, "rep long, links long, to long"))
    groups = common.connected_components(found.select("rep", "to"), "rep", "to")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.select("rep", "k1", "k2", "copies", "least").join(links, "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    named = common.cut(named)
    names = named.groupBy("root").agg(F.min("least").alias("class_id"))
    classes = named.join(names, "root").select("k1", "k2", "copies", F.coalesce("links", F.lit(0)).alias("links"), "class_id")
    out = every.select("doc", "k1", "k2", "n").join(classes, ["k1", "k2"], "left")
    return out.select(F.col("doc").alias("doc_id"), F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc")).alias("class_id"), F.when(F.col("n") > 0, F.col("links") + F.col("copies") - 1).otherwise(0).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("copies")).otherwise(1).cast("long").alias("copies"))


def query(spark, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that of least id, and once if its row repeats."""
    found = common.cut(join(docs.select("doc_id", "text")).where("n_links > 0"))
    kept = docs.join(found.where("doc_id <> class_id").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
    again = common.cut(found.groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():  # no id has two rows
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__rest")) if rest else kept.join(again, "doc_id", "left_semi").distinct()
    once = once.select("doc_id", "text", "__rest.*").select(*docs.columns) if rest else once.select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once)
