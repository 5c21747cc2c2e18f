"""Operator 11: ranked lexical search over inverted treaps.

Documents are searched in shards, by the tasks that read them. In a shard each term has a treap of its postings: a search tree by the
document's place (in order of id) and a heap by the term's impact there, so the root of a subtree tells the most that any of its
documents can gain. A query walks the treaps of its terms together. It starts with the whole range of documents; a range
whose summed maxima cannot enter the top k is dropped; another is split at the document of its greatest maximum, every
treap with it, and that document is scored exactly. The ranges of highest bound are split first, many at a time, as array operations.
What a task has found carries over to its next shards; each task returns k rows per query at most, and these are merged.

Impacts need counts over all documents, so there are two passes: the first stores for each document its length and how often it
holds each term of the queries (an aggregate over this gives the document frequencies), the second builds treaps and searches. Postings
are never shuffled. Queries are taken in blocks of some BLOCK_TERMS terms, so what is broadcast and collected is bounded however many
there are; a document contributes to a shard whatever its length.

Defined results: null and empty texts, and such without a term, are in no count and never found. A null item text finds
nothing. Rows that repeat a doc_id are documents of their own; a null id comes after all others of equal score. Rows of one item
id and text are one query, rows of one item id and different texts are ranked apart. Empty tables give an empty result. Other columns
are ignored.
"""

import bisect
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

TOP = 10
BLOCK_TERMS = 200_000  #: distinct terms, counted for each query by itself, of the queries that are searched together
SHARD_DOCS = 1 << 14
SHARD_POSTINGS = 2_000_000  #: from which a shard is full
WIDTH = 64  #: ranges split at once, or half of all if those are more
GROUPS = 64  #: parts in which a query's rows are merged first

#: A-Z become a-z; what is not a letter, digit or part of a longer code point becomes a space
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """All terms of a UTF-8 text, in order."""
    return text.translate(_FOLD).split()


def utf8(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]


def counted(docs: DataFrame, sent, id_col: str, text: str) -> DataFrame:
    """(doc, n, terms, tfs) of documents with a term: n counts all terms, the lists have those in sent.value (term to number)."""
    def run(batches):
        common.kept("lexical", None)
        number = sent.value.get
        for batch in batches:
            at, n, starts, nos, tfs = [], [], [0], [], []
            for i, body in enumerate(utf8(batch.column(1))):
                found = terms(body)
                if not found:
                    continue
                held = Counter(map(number, found))
                held.pop(None, None)
                at.append(i)
                n.append(len(found))
                nos += held.keys()
                tfs += held.values()
                starts.append(len(nos))
            offsets = pa.array(starts, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (nos, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), *lists], names=["doc", "n", "terms", "tfs"])

    rows = docs.select(F.col(id_col).alias("doc"), F.col(text).cast("string").alias("text"))
    return common.arrow(rows, run, f"doc {rows.schema[0].dataType.simpleString()}, n long, terms array<int>, tfs array<int>")


def nearest_greater(key: np.ndarray, cand: np.ndarray) -> np.ndarray:
    """For each element the nearest one of greater key in one direction. cand: the neighbour there, or len(key) - 1, whose key is greater than all."""
    active = np.flatnonzero(key[cand] < key[:-1])
    while len(active):
        cand[active] = cand[cand[active]]
        active = active[key[cand[active]] < key[active]]
    return cand


class Treaps:
    """Treaps of all terms of a shard. Arrays have one more element, an empty node that has no place, impact or children."""

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, n_terms: int):
        """One element per posting; places are below SHARD_DOCS or little more, impacts above 0."""
        order = np.lexsort((place, term))
        term, place, impact = term[order], place[order], impact[order]
        n = len(term)
        self.none = n
        self.place = np.append(place, 1 << 40)
        self.impact = np.append(impact, 0)
        # equal impacts are ordered by a scrambled place, so that runs of them stay shallow
        key = np.append((impact << 20) | ((place * 0x9E3B1 + 0x5A5A5) & 0xFFFFF), np.iinfo(np.int64).max)
        first = np.ones(n, bool)
        first[1:] = term[1:] != term[:-1]
        last = np.append(first[1:], True)[:n]
        before, after = np.arange(n) - 1, np.arange(n) + 1
        before[first], after[last] = n, n
        before, after = nearest_greater(key, before), nearest_greater(key, after)
        # the parent is the lesser of the two nearest greater ones: the one before has this node to its right
        right_of = key[before] < key[after]
        self.left, self.right = np.full(n + 1, n), np.full(n + 1, n)
        at = np.arange(n)
        self.right[before[right_of]] = at[right_of]
        left_of = ~right_of & (after < n)
        self.left[after[left_of]] = at[left_of]
        roots = (before == n) & (after == n)
        self.roots = np.full(n_terms, n)
        self.roots[term[roots]] = at[roots]

    def within(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Each node, or the highest one below it whose place is in [lo, hi)."""
        node = node.copy()
        at = np.flatnonzero(node != self.none)
        while len(at):
            x = node[at]
            low, high = self.place[x] < lo[at], self.place[x] >= hi[at]
            x = np.where(low, self.right[x], np.where(high, self.left[x], x))
            node[at] = x
            at = at[(low | high) & (x != self.none)]
        return node

    def split(self, node: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each node's treap: a node above all places below `by`, one above all places beyond it, and the impact there."""
        low, high, here = np.full(len(node), self.none), np.full(len(node), self.none), np.zeros(len(node), np.int64)
        at, x = np.arange(len(node)), node
        while True:
            some = x != self.none
            at, x = at[some], x[some]
            if not len(at):
                return low, high, here
            p, d = self.place[x], by[at]
            less, more, hit = p < d, p > d, p == d
            unset = low[at] == self.none
            low[at[less & unset]] = x[less & unset]
            low[at[hit & unset]] = self.left[x[hit & unset]]
            unset = high[at] == self.none
            high[at[more & unset]] = x[more & unset]
            high[at[hit & unset]] = self.right[x[hit & unset]]
            here[at[hit]] = self.impact[x[hit]]
            x = np.where(less, self.right[x], np.where(more, self.left[x], self.none))


def best_of(t: Treaps, nos: np.ndarray, times: np.ndarray, n_docs: int, k: int, bar: tuple[int, int], seen: list | None = None) -> list[tuple[int, int]]:
    """The k best (-score, place) of a query, whose terms are nos, repeated times; only such that are less than bar are sure to be among them. seen: gets how many documents are scored."""
    root = t.roots[nos]
    nos, times, root = nos[root != t.none], times[root != t.none], root[root != t.none]
    best: list[tuple[int, int]] = []
    if not len(nos):
        return best
    width = len(nos)
    node, lo, hi = root.reshape(1, -1), np.zeros(1, np.int64), np.full(1, n_docs)
    bound = (t.impact[node] * times).sum(1)
    while True:
        keep = (-bound < bar[0]) | ((-bound == bar[0]) & (lo < bar[1]))
        if not keep.all():
            node, lo, hi, bound = node[keep], lo[keep], hi[keep], bound[keep]
        if not len(lo):
            return best
        now = np.zeros(len(lo), bool)
        many = max(WIDTH, len(lo) // 2)
        now[np.argpartition(-bound, many - 1)[:many] if many < len(lo) else slice(None)] = True
        head, a, b = node[now], lo[now], hi[now]
        by = t.place[head[np.arange(len(head)), (t.impact[head] * times).argmax(1)]]
        low, high, here = t.split(head.ravel(), np.repeat(by, width))
        scores = (here.reshape(-1, width) * times).sum(1)
        if seen is not None:
            seen.append(len(scores))
        good = np.flatnonzero((-scores < bar[0]) | ((-scores == bar[0]) & (by < bar[1])))
        if len(good):
            good = good[np.lexsort((by[good], -scores[good]))[:k]]
            best = sorted(best + [(-s, p) for s, p in zip(scores[good].tolist(), by[good].tolist(), strict=True)])[:k]
            if len(best) == k:
                bar = min(bar, best[-1])
        lo2, hi2 = np.concatenate([a, by + 1]), np.concatenate([by, b])
        new = np.concatenate([low, high])
        new = t.within(new, np.repeat(lo2, width), np.repeat(hi2, width)).reshape(-1, width)
        node, lo, hi = np.concatenate([node[~now], new]), np.concatenate([lo[~now], lo2]), np.concatenate([hi[~now], hi2])
        bound = np.concatenate([bound[~now], (t.impact[new] * times).sum(1)])


def shard_of(parts: list[pa.RecordBatch], weights: np.ndarray, n_docs: int, n_terms: int) -> tuple[list, Treaps]:
    """The keys of a shard's documents in order, (is null, id), and its treaps."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    ids = [(x is None, 0 if x is None else x) for x in rows.column("doc").to_pylist()]
    order = sorted(range(len(ids)), key=ids.__getitem__)
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    n = rows.column("n").to_numpy()
    m = 25 + (75 * n * n_docs) // n_terms
    lists, tfs = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (rows.column("terms"), rows.column("tfs")))
    who = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64)
    impact = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[who]))
    some = impact > 0
    return [ids[i] for i in order], Treaps(term[some], place[who[some]], impact[some], len(weights))


def found_in(held: DataFrame, queries: list[dict[int, int]], weights: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(no, doc, score): the k best of each task's documents for each query."""
    sent = held.sparkSession.sparkContext.broadcast(([(np.array(list(q), np.int64), np.array(list(q.values()), np.int64)) for q in queries], weights))

    def run(batches):
        common.kept("lexical", None)
        asked, w = sent.value
        best: list[list] = [[] for _ in asked]  # (-score, key) of each query
        kind, parts, docs, postings = pa.null(), [], 0, 0

        def search():
            keys, treaps = shard_of(parts, w, n_docs, n_terms)
            for i, (nos, times) in enumerate(asked):
                had = best[i]
                bar = (had[-1][0], bisect.bisect_left(keys, had[-1][1])) if len(had) == k else (0, 0)
                got = best_of(treaps, nos, times, len(keys), k, bar)
                if got:
                    best[i] = sorted(had + [(s, keys[p]) for s, p in got])[:k]

        for batch in batches:
            kind = batch.schema.field(0).type
            if len(batch):
                parts.append(batch)
                docs, postings = docs + len(batch), postings + len(batch.column(2).flatten())
            if docs >= SHARD_DOCS or postings >= SHARD_POSTINGS:
                search()
                parts, docs, postings = [], 0, 0
        if parts:
            search()
        flat = [(i, None if key[0] else key[1], -s) for i, of in enumerate(best) for s, key in of]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in flat], pa.int32()), pa.array([r[1] for r in flat], kind), pa.array([r[2] for r in flat], pa.int64())], names=["no", "doc", "score"])

    return common.arrow(held, run, f"no int, doc {held.schema['doc'].dataType.simpleString()}, score long")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_col, rank, id_col, score): for each item the k documents of highest score above 0."""
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()

    def run(batches):
        for batch in batches:
            held = [Counter(terms(body)) for body in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([[x.decode() for x in h] for h in held], pa.list_(pa.string())), pa.array([list(h.values()) for h in held], pa.list_(pa.int32()))], names=["item", "text", "terms", "times"])

    kind = asked.schema["item"].dataType
    asked = common.cut(common.arrow(asked, run, f"item {kind.simpleString()}, text string, terms array<string>, times array<int>").where(F.size("terms") > 0).withColumn("h", F.xxhash64("text")).drop("text"))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_TERMS))
    out = None
    for b in range(blocks):
        rows = asked.where(F.pmod("h", F.lit(blocks)) == b).select("item", "terms", "times").collect() if total else []
        found = searched(docs, rows, k, id_col, text).join(F.broadcast(spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], f"no int, item {kind.simpleString()}")), "no")
        found = found.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    return out


def searched(docs: DataFrame, asked: list, k: int, id_col: str, text: str) -> DataFrame:
    """(no, rank, doc, score) of one block of queries: rows with terms and times."""
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    queries = [{number.setdefault(t.encode(), len(number)): n for t, n in zip(r.terms, r.times, strict=True)} for r in asked]
    held = common.cut(counted(docs, spark.sparkContext.broadcast(number), id_col, text))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
    weights = np.zeros(len(number), np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as the block has terms at most
        weights[r.term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    rows = found_in(held, queries, weights, n_docs, n_terms, k)
    order = (F.desc("score"), F.asc_nulls_last("doc"))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("no", F.pmod(F.xxhash64("doc"), F.lit(GROUPS))).orderBy(*order))).where(F.col("rank") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("no").orderBy(*order))).where(F.col("rank") <= k)
    return best.select("no", "rank", "doc", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH doc AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS terms FROM doc WHERE len(w) > 0),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, unnest(w) AS term FROM item) GROUP BY ALL),
held AS (SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT row, doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM doc) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM held, total GROUP BY term),
gain AS (SELECT row, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))) AS g FROM held JOIN weight USING (term), total),
scored AS (SELECT item_id, row, doc_id, sum(times * g)::BIGINT AS score FROM asked JOIN gain USING (term) GROUP BY ALL),
ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10"""
