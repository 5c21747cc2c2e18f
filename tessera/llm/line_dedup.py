"""Operator 2: line dedup by pairwise alignment.

Lines are hashed, those of fewer than five words together with the line before them. One that occurs in two or more
documents is shared, and the document of least id that has it is its owner. So have runs of 2, 4, 8, ... neighbouring shared lines each
their owner, the first document that holds the run; a passage is covered by two runs of its longest scale, so its holder is found
though others own its lines. A later document is paired with the owners of its shared lines and runs (one row for
each document, line and scale, never a pair of all holders), and each pair is aligned where the owner's lines are: an owner's places stand in a task once,
and again for every further slice of its pairs, which hold as many lines as it has itself. So what moves grows with the sum of the
two documents' lines, also if a line stands a million times in an owner. The two documents' shared lines are aligned with patience diff: what
they begin and end with alike is matched, lines that occur once in both are anchors, the longest increasing run of anchors
is kept, and the stretches between them are aligned in the same way, where lines may be unique that are not so in the whole.
A stretch without any such line matches the n-th occurrence with the n-th, the longest increasing run of these.

What any of a document's alignments takes is pooled, and blocks (runs of neighbouring lines) of MIN_WORDS words or more are
deleted, and shorter ones that hold a line of LINE_WORDS words or more which COMMON_DOCS documents or more share. Other short
blocks, of rare or very short lines, stay. Each owner is aligned once, so of two blocks that changed places against it only one is taken there.

The ids of documents are whole numbers, or texts of such.

Defined results: null and empty texts have one empty line and lose none. Lines are compared after trimming outer
white space. Rows of null id take no part and stay. Rows that repeat an id count as one document of that id, later
rows' lines behind earlier ones', and each such row loses the lines that a copy of its own line sequence would lose.
An empty table gives an empty table. A document that is wholly repeated keeps an empty text. Columns of any name pass through; the counts are a struct of its own, DROPPED.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

LINE_WORDS = 5  #: words of a line that is compared alone
MIN_WORDS = 10  #: words of an aligned block that is deleted
COMMON_DOCS = 3  #: documents that hold a line of LINE_WORDS words or more, from which a shorter block goes with it

BLANK = " \t\n\x0b\f\r"  #: what is trimmed from lines
SLICE_LINES = 2000  #: lines of an owner's pairs that one task is meant to align at least
DROPPED = "__dropped"  #: the struct (lines, words, of) that tells what a document has lost

MATCHES = "doc long, text_hash long, lines array<int>"
PAIRS = "doc long, text_hash long, owner long, at array<int>, lines array<long>, words array<int>, common array<boolean>, extra array<int>, extra_lines array<long>"
TAKEN = "doc long, text_hash long, at array<int>, words array<int>, common array<boolean>"


def words_in(line: Column) -> Column:
    return F.size(F.split(line, r"\s+"))


def lines_of(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(doc, text_hash, pos, words, h1, h2): h1 and h2 are 128 bits of the trimmed line's hash."""
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.transform(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(BLANK)))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(body).alias("text_hash"), trimmed.alias("all"))
    rows = rows.select("doc", "text_hash", F.posexplode(F.transform("all", lambda x, i: F.struct(x.alias("line"), F.when(i > 0, F.get("all", i - 1)).alias("before")))).alias("pos", "x"))
    rows = rows.select("doc", "text_hash", "pos", F.col("x.line").alias("line"), F.col("x.before").alias("before"), F.when(F.col("x.line") == "", 0).otherwise(words_in(F.col("x.line"))).alias("words"))
    context = F.when(F.col("words") < LINE_WORDS, F.concat(F.lit("<"), F.coalesce("before", F.lit("")))).otherwise(F.lit(">"))
    return rows.select("doc", "text_hash", "pos", "words", F.xxhash64("line", context).alias("h1"), F.xxhash64(F.lit(29), context, "line").alias("h2"))


def increasing(at: list[int]) -> list[int]:
    """Indexes of a longest increasing subsequence of at."""
    tails, ends, back = [], [], []
    for i, x in enumerate(at):
        k = bisect.bisect_left(tails, x)
        back.append(ends[k - 1] if k else -1)
        if k == len(tails):
            tails.append(x)
            ends.append(i)
        else:
            tails[k], ends[k] = x, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(mine: list[tuple[int, int]], theirs: list[tuple[int, int]]) -> set[int]:
    """Positions of mine aligned with theirs; both are (position, line) in order of position."""
    number: dict = {}
    told = lambda x: number.setdefault(x, len(number))
    return aligned_in([(p, told(x)) for p, x in mine], np.array([told(x) for _, x in theirs], np.int64))


def aligned_in(mine: list[tuple[int, int]], theirs: np.ndarray) -> set[int]:
    """Positions of mine, (position, line) in order, aligned with theirs, lines in order. Theirs may be far longer: a stretch costs its own lines times a search."""
    order = np.argsort(theirs, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(theirs[order])) + 1, len(theirs))
    at_line = dict(zip(theirs[order[ends - 1]].tolist(), np.split(order, ends[:-1]), strict=True)) if len(theirs) else {}
    none = np.zeros(0, np.int64)
    taken: set[int] = set()
    stretches = [(0, len(mine), 0, len(theirs))]
    while stretches:
        a, a_end, b, b_end = stretches.pop()
        while a < a_end and b < b_end and mine[a][1] == theirs[b]:
            taken.add(mine[a][0])
            a, b = a + 1, b + 1
        while a < a_end and b < b_end and mine[a_end - 1][1] == theirs[b_end - 1]:
            taken.add(mine[a_end - 1][0])
            a_end, b_end = a_end - 1, b_end - 1
        if a == a_end or b == b_end:
            continue
        here: dict[int, list[int]] = {}
        for i in range(a, a_end):
            here.setdefault(mine[i][1], []).append(i)
        there = {}
        for line in here:
            places = at_line.get(line, none)
            lo, hi = places.searchsorted((b, b_end)).tolist()
            there[line] = places[lo : min(hi, lo + max(2, len(here[line])))].tolist()
        pairs = sorted((at[0], there[line][0]) for line, at in here.items() if len(at) == 1 and len(there[line]) == 1)
        recurse = bool(pairs)
        if not recurse:
            pairs = sorted(pair for line, at in here.items() for pair in zip(at, there[line], strict=False))
        pairs = [pairs[i] for i in increasing([j for _, j in pairs])]
        taken.update(mine[i][0] for i, _ in pairs)
        if recurse:
            ends_of = [(a - 1, b - 1), *pairs, (a_end, b_end)]
            stretches += [(i + 1, i2, j + 1, j2) for (i, j), (i2, j2) in zip(ends_of, ends_of[1:], strict=False) if i + 1 < i2 and j + 1 < j2]
    return taken


def diagonals(runs: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(position, their position) of every line in runs of (position, lines, their first position), each once."""
    out, so_far = [], {}
    for p, n, q in sorted(runs):
        begin = max(p, so_far.get(q - p, 0))
        out += [(x, x + q - p) for x in range(begin, p + n)]
        so_far[q - p] = max(begin, p + n)
    return out


def paired(rows: list[tuple]) -> list[tuple]:
    """One document's pairs: (owner, positions, their lines, words, whether common, and on the diagonals of runs the owner's positions and their lines).
    rows: (scale, words, line, holders, owner, my positions, the owner's); words, line and holders where scale is 0, the owner's positions elsewhere."""
    line: dict[int, int] = {}
    words: dict[int, int] = {}
    common_ones: set[int] = set()
    here: dict[int, set[int]] = {}  # owner, my positions
    there: dict[int, dict[int, int]] = {}  # owner, its position, the line there
    runs: dict[int, list[tuple[int, int, int]]] = {}
    for scale, n, key, count, owner, mine, theirs in rows:
        if scale:
            runs.setdefault(owner, []).extend((p, 1 << scale, q) for p, q in zip(mine, theirs, strict=True))
            continue
        for p in mine:
            line[p], words[p] = key, n
        if n >= LINE_WORDS and count >= COMMON_DOCS:
            common_ones.update(mine)
        here.setdefault(owner, set()).update(mine)
    for owner, found in runs.items():
        for p, q in diagonals(found):
            here.setdefault(owner, set()).add(p)
            there.setdefault(owner, {})[q] = line[p]
    out = []
    for owner, of in here.items():
        at, extra = sorted(of), there.get(owner, {})
        out.append((owner, at, [line[p] for p in at], [words[p] for p in at], [p in common_ones for p in at], list(extra), list(extra.values())))
    return out


def aligned_with(own: dict[int, np.ndarray], at: list[int], lines: list[int], extra: list[int], extra_lines: list[int]) -> set[int]:
    """Positions of a pair that are aligned. own: the owner's positions by line."""
    held = {x: own[x] for x in set(lines) if x in own}
    places = np.concatenate([*held.values(), np.array(extra, np.int64)])
    labels = np.concatenate([*(np.full(len(v), x, np.int64) for x, v in held.items()), np.array(extra_lines, np.int64)])
    _, first = np.unique(places, return_index=True)  # in order of position, each once
    return aligned_in(list(zip(at, lines, strict=True)), labels[first])


def blocks(taken: dict[int, tuple[int, bool]]) -> list[int]:
    """The positions that go, of those that alignments have taken: position, (words, whether common)."""
    out, block = [], []
    for p in [*sorted(taken), None]:
        if block and (p is None or p != block[-1] + 1):
            if sum(taken[x][0] for x in block) >= MIN_WORDS or any(taken[x][1] for x in block):
                out += block
            block = []
        block.append(p)
    return out


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes, in order."""
    def stir(x):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    return stir(stir(a + np.uint64(0x9E3779B97F4A7C15)) + b)


def runs_of(shared: DataFrame) -> DataFrame:
    """(doc, text_hash, pos, scale, h1, h2): each run of 2, 4, 8, ... neighbouring lines that are all shared."""
    names = ("doc", "text_hash", "pos", "h1", "h2")

    def run(batches):
        held: list = []

        def found(columns):
            doc, text_hash, pos, h1, h2 = columns
            h1, h2, scale, n = h1.view(np.uint64), h2.view(np.uint64), 0, len(doc)
            begins = np.ones(n, bool)
            begins[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1]) | (pos[1:] != pos[:-1] + 1)
            firsts = np.flatnonzero(begins)
            ends = np.repeat(np.append(firsts[1:], n), np.diff(np.append(firsts, n)))  # where each row's section ends
            at = np.arange(n)
            while len(at := at[at + (2 << scale) <= ends[at]]):
                half = 1 << scale
                old1, old2 = h1, h2
                h1, h2 = h1.copy(), h2.copy()
                h1[at], h2[at] = mixed(old1[at], old1[at + half]), mixed(old2[at], old2[at + half])
                scale += 1
                for i in range(0, len(at), 10_000):
                    x = at[i : i + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array(doc[x]), pa.array(text_hash[x]), pa.array(pos[x]), pa.array(np.full(len(x), scale, np.int32)), pa.array(h1[x].view(np.int64)), pa.array(h2[x].view(np.int64))], names=["doc", "text_hash", "pos", "scale", "h1", "h2"])

        for batch in batches:
            columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
            if not len(columns[0]):
                continue
            held.append(columns)
            # the last document may go on in the next batch
            last = np.flatnonzero((columns[0] != columns[0][-1]) | (columns[1] != columns[1][-1]))
            if len(last) or (len(held) > 1 and (held[-2][0][-1], held[-2][1][-1]) != (columns[0][0], columns[1][0])):
                n = last[-1] + 1 if len(last) else 0
                rest = [c[n:] for c in columns]
                held[-1] = [c[:n] for c in columns]
                yield from found([np.concatenate(c) for c in zip(*held, strict=True)])
                held = [rest]
        if held:
            yield from found([np.concatenate(c) for c in zip(*held, strict=True)])

    rows = shared.select(*names).repartition("doc", "text_hash").sortWithinPartitions("doc", "text_hash", "pos")
    return common.arrow(rows, run, "doc long, text_hash long, pos int, scale int, h1 long, h2 long")


def find(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text_hash, lines): positions of the lines to delete, for documents that lose any."""
    lines = common.cut(lines_of(docs, id_col, text).groupBy("h1", "h2", "doc", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("at"), F.first("words").alias("words")))
    owners = lines.groupBy("h1", "h2").agg(F.min(F.struct("doc", "text_hash", "at")).alias("o"), F.max("doc").alias("latest"), F.count("*").alias("holders"))
    # written, so that the join below has a shuffle of its own and a line with very many holders can be split
    owners = common.cut(owners.where("o.doc < latest").select("h1", "h2", F.col("o.doc").alias("owner"), F.col("o.at").alias("theirs"), "holders"))
    shared = common.cut(lines.join(owners.drop("theirs"), ["h1", "h2"]).select("doc", "text_hash", "h1", "h2", "at", "words", "holders", "owner"))
    runs = common.cut(runs_of(shared.withColumn("pos", F.explode("at"))).groupBy("scale", "h1", "h2", "doc", "text_hash").agg(F.sort_array(F.collect_list("pos")).alias("at")))
    first = runs.groupBy("scale", "h1", "h2").agg(F.min(F.struct("doc", "text_hash", "at")).alias("o"), F.max("doc").alias("latest"))
    first = common.cut(first.where("o.doc < latest").select("scale", "h1", "h2", F.col("o.doc").alias("owner"), F.col("o.at").alias("theirs")))
    # a run is held against one of the owner's, the n-th against the n-th
    nth = F.transform("at", lambda _, i: F.get("theirs", F.least(i, F.size("theirs") - 1)))
    longer = runs.join(first, ["scale", "h1", "h2"]).where("doc > owner").select("doc", "text_hash", "scale", F.lit(0).alias("words"), F.lit(0).cast("long").alias("h1"), F.lit(0).cast("long").alias("holders"), "owner", F.col("at").alias("mine"), nth.alias("theirs"))
    single = shared.where("doc > owner").select("doc", "text_hash", F.lit(0).alias("scale"), "words", "h1", "holders", "owner", F.col("at").alias("mine"), F.array().cast("array<int>").alias("theirs"))
    # all matches of one document meet, at most one for each of its lines and scales; a line with many holders is spread over them
    names = ("scale", "words", "h1", "holders", "owner", "mine", "theirs")
    pairs = common.cut(grouped(single.unionByName(longer), ("doc", "text_hash"), names, lambda key, rows: [(*key, *p) for p in paired(rows)], PAIRS))
    # pairs of an owner are dealt to slices that hold as many lines as it has itself, or SLICE_LINES
    sizes = pairs.groupBy("owner").agg(F.sum(F.size("at")).alias("n")).join(owners.groupBy("owner").agg(F.sum(F.size("theirs")).alias("own")), "owner", "left")
    sizes = common.cut(sizes.select("owner", F.ceil(F.col("n") / F.greatest(F.coalesce("own", F.lit(0)), F.lit(SLICE_LINES))).cast("int").alias("slices")))
    asked = pairs.join(sizes, "owner").withColumn("slice", F.pmod(F.xxhash64("doc", "text_hash"), F.col("slices")).cast("int")).drop("slices")
    held = owners.join(sizes, "owner").select("owner", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(None).cast("long").alias("doc"), F.col("theirs").alias("at"), F.array("h1").alias("lines"))
    units = asked.unionByName(held, allowMissingColumns=True)

    def align(key, rows):
        # rows without a document are the owner's, and come first
        own = {lines[0]: np.array(at, np.int64) for doc, _, at, lines, *_ in rows if doc is None}
        for doc, text_hash, at, lines, words, common_ones, extra, extra_lines in rows:
            if doc is not None:
                gone = aligned_with(own, at, lines, extra, extra_lines)
                some = [i for i, p in enumerate(at) if p in gone]
                if some:
                    yield doc, text_hash, [at[i] for i in some], [words[i] for i in some], [common_ones[i] for i in some]

    taken = grouped(units, ("owner", "slice"), ("doc", "text_hash", "at", "lines", "words", "common", "extra", "extra_lines"), align, TAKEN, order=(F.asc_nulls_first("doc"),))

    def pool(key, rows):
        every = {p: (n, c) for at, words, common_ones in rows for p, n, c in zip(at, words, common_ones, strict=True)}
        gone = blocks(every)
        return [(*key, gone)] if gone else []

    return grouped(taken, ("doc", "text_hash"), ("at", "words", "common"), pool, MATCHES)


def grouped(rows: DataFrame, by: tuple[str, ...], names: tuple[str, ...], build, schema: str, order: tuple = ()) -> DataFrame:
    """What build(key, rows of a key as tuples of names) gives for each key of by. Rows of a key meet in a task, sorted, and are held one key at a time."""
    def run(batches):
        held, now = [], None

        def out_of(found):
            found = list(found)
            fields = kinds.names
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], kinds.field(i).type) for i in range(len(fields))], names=fields)

        for batch in batches:
            keys, values = [batch.column(n).to_pylist() for n in by], [batch.column(n).to_pylist() for n in names]
            out = []
            for key, row in zip(zip(*keys, strict=True), zip(*values, strict=True), strict=True):
                if key != now:
                    out += build(now, held) if held else ()
                    held, now = [], key
                held.append(row)
            yield out_of(out)
        yield out_of(build(now, held) if held else ())

    kinds = to_arrow_schema(StructType.fromDDL(schema))
    dealt = rows.repartition(*by).sortWithinPartitions(*by, *order)
    return common.arrow(dealt, run, schema)


def marked(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, its columns in their order, the text without the deleted lines, and DROPPED, a struct of how many lines and words went and how many lines there were."""
    gone = find(docs, id_col, text).withColumnsRenamed({"doc": "of", "text_hash": "hash"})
    rest = [c for c in docs.columns if c not in (id_col, text)]
    # columns whose names may be any go in a struct of their own, by number
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest)], F.lit(0).alias("none")).alias("rest"))
    rows = rows.withColumn("key", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = rows.join(gone, (F.col("id").cast("long") == F.col("of")) & (F.col("key") == F.col("hash")), "left").select("id", "rest", "text", "lines")
    counts = "struct<lines:bigint,words:bigint,of:bigint>"

    def run(batches):
        common.kept("lines", None)
        for batch in batches:
            kept, told = [], []
            for t, g in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                n, w = 1 if t is None else t.count("\n") + 1, 0
                if g:
                    lines, drop = t.split("\n"), set(g)
                    w = sum(len(lines[i].split()) for i in drop)
                    t = "\n".join(x for i, x in enumerate(lines) if i not in drop)
                kept.append(t)
                told.append({"lines": len(g or ()), "words": w, "of": n})
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(kept, pa.string()), pa.array(told, pa.struct([("lines", pa.int64()), ("words", pa.int64()), ("of", pa.int64())]))], names=["id", "rest", "text", DROPPED])

    out = common.arrow(rows, run, f"id {rows.schema['id'].dataType.simpleString()}, rest {rows.schema['rest'].dataType.simpleString()}, text string, {DROPPED} {counts}")
    column = lambda c: F.col("id").alias(c) if c == id_col else F.col("text").alias(c) if c == text else F.col(f"rest.c{rest.index(c)}").alias(c)
    return out.select(*[column(c) for c in docs.columns], DROPPED)


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of docs, text without the deleted lines, and `removed_lines`, `removed_words`, `n_lines`; of these not those whose names docs has itself, which stay its own."""
    names = {"removed_lines": "lines", "removed_words": "words", "n_lines": "of"}
    out = marked(docs, id_col, text)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"{DROPPED}.{v}").alias(k) for k, v in names.items() if k not in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "removed_lines", "removed_words", "text")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what repeats an earlier one; one that is wholly repeated goes."""
    out = marked(docs)
    out = out.where((F.col(f"{DROPPED}.lines") == 0) | (F.length(F.trim(F.col("text"))) > 0)).drop(DROPPED)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
