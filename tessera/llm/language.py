"""Operator 10: language ID by cross-parsing entropy.

For each language a suffix automaton of labelled text answers "does this string occur there?". A text is
parsed greedily into the longest matches with that automaton (Ziv-Merhav cross parsing); each phrase costs
log2(training length) bits. The language that needs the fewest bits for each symbol wins. All segments of SEGMENT symbols of all texts are
parsed at once, each as if a phrase began there; then those in whose beginning the phrase before goes on are parsed again, until a phrase
begins at the same place in both, so the phrases are those of one parse from end to end. A worker holds TABLE_BYTES of dense transitions, for all
languages together, and beside them the sparse ones of the rarer letters: a few numbers for each symbol of the sample, which has SAMPLE_TOTAL
symbols at most, shared evenly by the languages. More than MOST_LANGS languages are an error.

Defined results: a null text, an empty text and a text without a letter get `und` and score 0. Equal costs go
to the language first in code-point order. Training rows with null text or lang are left out; if no row can be
learned from, every text gets `und`. Repeated rows are predicted each on its own. Other columns are ignored.
"""

import json
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS = 400  #: different training texts of each language, those of least hash
SAMPLE_SYMBOLS = 1 << 16  #: symbols of normalised training text of each language
SAMPLE_TOTAL = 1 << 21  #: symbols of all languages together
MOST_LANGS = SAMPLE_TOTAL >> 8  #: so that each has 256 symbols at least
TABLE_BYTES = 128 << 20  #: of all languages' dense transitions, of the commonest symbols; the others' are sparse
SEGMENT = 512  #: symbols parsed in a run, before runs are joined
ODD = 0.62  #: phrases per symbol from which a text counts as in none of the languages

_letters: list[np.ndarray] = []


def _lower() -> np.ndarray:
    """For each code point, that of its lower-case letter; 0 for what is no letter."""
    if not _letters:
        out = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters.append(out)
    return _letters[0]


def symbols(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts as code points, each run of other characters as one 0, and each text's offset in them."""
    parts = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    codes = _lower()[np.concatenate([*parts, np.zeros(0, np.uint32)])]
    keep = codes != 0
    keep[1:] |= codes[:-1] != 0
    starts = bounds[:-1][bounds[:-1] < bounds[1:]]
    keep[starts] = codes[starts] != 0  # a text never begins with a gap
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]


Table = tuple[np.ndarray, np.ndarray, np.ndarray, int]


def automaton(seq: list[int], size: int, most: int = TABLE_BYTES) -> Table:
    """Transitions of the suffix automaton of seq over symbols below size; 0 (the root) where there is none.

    Those of the first symbols, as many as fit in `most` bytes, are an array [state, symbol]; beside it are the others' sorted keys
    (state * size + symbol), their targets, and size.
    """
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p != -1:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    count = np.array([len(d) for d in nexts])
    states = np.repeat(np.arange(len(nexts), dtype=np.int64), count)
    by = np.fromiter((c for d in nexts for c in d), np.int64, count.sum())
    to = np.fromiter((t for d in nexts for t in d.values()), np.int32, count.sum())
    width = max(1, min(size, most // (4 * len(nexts))))
    dense, near = np.zeros((len(nexts), width), np.int32), by < width
    dense[states[near], by[near]] = to[near]
    keys, to = (states * size + by)[~near], to[~near]
    order = np.argsort(keys)
    return dense, keys[order], to[order], size


def step(table: Table, state: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Where each state goes with its symbol."""
    dense, keys, targets, size = table
    width = dense.shape[1]
    if width == size or not len(c) or c.max() < width:
        return dense.ravel()[state * width + c]
    out, far = np.zeros(len(c), np.int32), c >= width
    out[~far] = dense.ravel()[state[~far] * width + c[~far]]
    if len(keys):
        sought = state[far] * size + c[far]
        at = np.minimum(np.searchsorted(keys, sought), len(keys) - 1)
        out[far] = np.where(keys[at] == sought, targets[at], 0)
    return out


def symbols_of_each(languages: int) -> int:
    return min(SAMPLE_SYMBOLS, SAMPLE_TOTAL // max(1, languages))


def _load(model: str) -> tuple:
    """Languages, code point to symbol, and for each language its automaton and bits per phrase."""
    texts = json.loads(model)
    codes = {lang: symbols([t])[0][: symbols_of_each(len(texts))] for lang, t in texts.items()}
    known, times = np.unique(np.concatenate([*codes.values(), np.zeros(1, np.uint32)]), return_counts=True)
    known = known[np.argsort(-times, kind="stable")]
    to = np.full(0x110000, len(known), np.uint32)  # the last symbol: letters not seen, in no transition
    to[known] = np.arange(len(known))
    most = TABLE_BYTES // max(1, len(codes))
    return list(texts), to, [(automaton(to[c].tolist(), len(known) + 1, most), math.log2(max(2, len(c)))) for c in codes.values()]


def advance(table: Table, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each state goes with its symbol, and whether a phrase begins with it; a symbol that is in no phrase is one by itself."""
    to = step(table, state, c)
    fails = to == 0
    begins = fails | (state == 0)
    if fails.any():
        to[fails] = step(table, np.zeros(fails.sum(), np.int64), c[fails])
    return to, begins


def phrases(seq: np.ndarray, offsets: np.ndarray, table: Table) -> np.ndarray:
    """Phrases of each text's cross parsing. All segments step together, longest first, so that each step is a few array operations."""
    lengths = np.diff(offsets)
    per = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[:-1][owner] + nth * SEGMENT
    size = np.minimum(SEGMENT, offsets[1:][owner] - start)
    begins = np.zeros(len(seq), bool)  # where phrases begin
    order = np.argsort(-size, kind="stable")
    by_size, long = start[order], size[order]
    state = np.zeros(len(start), np.int64)
    active = np.searchsorted(-long, -np.arange(long[0] if len(long) else 0), side="left")
    for t, n in enumerate(active.tolist()):
        at = by_size[:n] + t
        state[:n], begins[at] = advance(table, state[:n], seq[at].astype(np.int64))
    ends = np.zeros(len(start), np.int64)  # the state behind each segment
    ends[order] = state
    todo = np.flatnonzero((nth > 0) & (np.append(0, ends[:-1]) != 0))
    while len(todo):
        here, state, t, changed = todo, ends[todo - 1], 0, []
        while len(here):
            at = start[here] + t
            state, new = advance(table, state, seq[at].astype(np.int64))
            met = new & begins[at]
            begins[at] = new
            t += 1
            over = ~met & (size[here] == t)
            other = over & (ends[here] != state)
            changed.append(here[other])
            ends[here[other]] = state[other]
            going = ~met & ~over
            here, state = here[going], state[going]
        # a segment that ends otherwise than before changes the beginning of the next
        todo = np.concatenate(changed) + 1
        todo = todo[todo < len(start)]
        todo = np.sort(todo[nth[todo] > 0])
    total = np.concatenate([[0], np.cumsum(begins)])
    return total[offsets[1:]] - total[offsets[:-1]]


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang") -> str:
    """The model: a bounded sample of the text of each language (SAMPLE_DOCS, symbols_of_each()), by least text hash."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.xxhash64("text"))
    kept = common.cut(rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts")))
    langs = kept.count()
    if langs > MOST_LANGS:
        raise ValueError(f"{langs} languages are labelled; {MOST_LANGS} can be learned.")
    most = symbols_of_each(langs)
    # the least hashes are among those below a share that holds some three times as many texts; copies of a text meet before they move
    below = F.pmod("h", F.lit(1 << 30)) * F.col("texts") < F.lit(float((3 * SAMPLE_DOCS + 64) << 30))
    # a document counts with its first characters, as many as its language has symbols at most, so that the sample's size is bounded
    rows = rows.join(F.broadcast(kept), "lang").where(below).groupBy("lang", "h").agg(F.min(F.substring("text", 1, most)).alias("text"))
    best = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h")
    least = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= SAMPLE_DOCS)
    so_far = F.sum(F.length("text")).over(best.rowsBetween(Window.unboundedPreceding, -1))
    least = least.withColumn("before", F.coalesce(so_far, F.lit(0))).where(F.col("before") < most)
    sample: dict[str, list] = {}
    for r in sorted(least.collect(), key=lambda r: (r.lang, r.n)):
        sample.setdefault(r.lang, []).append(r.text)
    return json.dumps({k: " ".join(v) for k, v in sample.items()})


def predict(docs: DataFrame, model: str, id_col: str = "doc_id", text: str = "text", also: tuple[str, ...] = (), keep: bool = False) -> DataFrame:
    """id_col, the columns `also`, the text too if keep, lang_pred, score (share of the winner's inverse cost), bits (cost per symbol) and rate (phrases per symbol)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, to, tables = common.kept("language", sent.value, lambda: _load(sent.value))
        for batch in batches:
            column = batch.column(len(batch.schema) - 1)
            chars = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
            for lo, hi in common.by_bytes(chars, 2_000_000):
                part = batch.slice(lo, hi - lo)
                seq, offsets = symbols(common.texts_of(part.column(len(batch.schema) - 1)))
                n = np.diff(offsets)
                seq = to[seq]
                found = np.array([phrases(seq, offsets, t) for t, _ in tables]).reshape(len(tables), len(n))
                bits = found * np.array([b for _, b in tables]).reshape(-1, 1) / np.maximum(n, 1)
                none = (n == 0) | (not langs)
                best = bits.argmin(0) if langs else np.zeros(len(n), int)
                at = np.arange(len(n))
                cost = np.where(none, 0.0, bits[best, at]) if langs else np.zeros(len(n))
                score = np.where(none, 0.0, (1 / np.maximum(bits, 1e-9)).max(0) / (1 / np.maximum(bits, 1e-9)).sum(0)) if langs else cost
                rate = np.where(none, 0.0, found[best, at] / np.maximum(n, 1)) if langs else cost
                pred = ["und" if x else langs[b] for x, b in zip(none.tolist(), best.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names) - 4], pa.array(pred, pa.string()), pa.array(score), pa.array(cost), pa.array(rate)], names=names)

    rows = docs.select(id_col, *also, text)
    passed = rows.schema.fields[: None if keep else -1]
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in passed]
    names = [*(f.name for f in passed), "lang_pred", "score", "bits", "rate"]
    return common.arrow(rows, run, ", ".join([*kinds, "lang_pred string, score double, bits double, rate double"]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.round("rate", 6).alias("phrase_rate"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the learned languages; those without a letter, or that no language explains, go."""
    rest = F.struct(*[c for c in docs.columns if c not in ("doc_id", "text")]).alias("__rest")  # apart, as its names may be any
    found = predict(docs.select("doc_id", rest, "text"), fit(docs.where(~held_out())), also=("__rest",), keep=True)
    return found.where((F.col("lang_pred") != "und") & (F.col("rate") < ODD)).select("doc_id", "text", "__rest.*").select(*docs.columns)
