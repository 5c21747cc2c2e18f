"""Operator 12: quality classifier by naive Bayes support vectors.

Features are indicators of n-grams: single words and pairs of neighbouring words, and 1 to SHAPES neighbouring shapes. Shapes are a
word's case (lower, upper, title, mixed), a repeat of the word before, a number, and other characters than spaces one by one, runs of one
character once; a text's beginning and end have shapes too. N-grams are hashed to BUCKETS buckets. Each kept feature is scaled by the log of
the ratio of its share in texts of label 1 and of label 0 (add-one smoothed, over the labelled sample), a document's vector is scaled to length
one, and a linear model of hinge loss is fitted on these by dual coordinate descent. A logistic curve of the margin, fitted on a fifth of the sample
that the model has not seen, gives the score.

The labelled sample (about FIT_DOCS different texts by hash, all if fewer, of rows that are not held out) is made in Spark, and
its counts too; only kept features (VOCABULARY at most) of the sample come to the driver.

Defined results: null and empty texts have the beginning and the end as features and are scored like any. Labels that are null, or that
belong to no document, are not learned from; an id or a text labelled twice counts by its lowest label. Rows of null id are scored, not held
out, never learned from. Without both labels every document gets the one label's score, 1 or 0, and 0.5 without any.
Other columns are ignored. An empty table gives an empty result.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .language import held_out
from .ngram_join import MIX, mixed

FIT_DOCS = 12_000  #: expected different labelled texts of the sample
SHAPES = 4
BITS = 20
BUCKETS = 1 << BITS
VOCABULARY = 20_000  #: features kept, by the z-score of their association with either label
LEAST_DOCS = 5  #: labelled texts that have a kept feature
LEAST_Z = 3.0
COST = 1.0  #: of a text's hinge loss against the squared weights
EPOCHS = 40
SEED = 7

# classes of bytes: other characters are themselves
_LOWER, _UPPER, _DIGIT = 1, 2, 3
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = _LOWER
_CLASS[65:91] = _UPPER
_CLASS[48:58] = _DIGIT
# shapes of words, beside 0 to 255 of single bytes
_SHAPE_LOWER, _SHAPE_UPPER, _SHAPE_TITLE, _SHAPE_MIXED, _SHAPE_AGAIN, _BEGIN, _END = range(256, 263)
_POWER = np.full(1 << 12, np.uint64(0x100000001B3)).cumprod(dtype=np.uint64)  # of a word's bytes beyond, the last one counts
_PAIR = np.uint64(0x2545F4914F6CDD1D)


def bucket(x: np.ndarray) -> np.ndarray:
    return ((x * MIX) >> np.uint64(64 - BITS)).astype(np.int32)


def grams(text: bytes) -> np.ndarray:
    """The buckets of a UTF-8 text's n-grams, with repeats."""
    data = np.frombuffer(text, np.uint8)
    kind = _CLASS[data]
    letter = (kind == _LOWER) | (kind == _UPPER)
    begins = np.ones(len(data), bool)
    begins[1:] = np.where(letter[1:], ~letter[:-1], kind[1:] != kind[:-1])  # a token is a run of letters, of digits, or of one other byte
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, len(data)))
    shape = kind[start].astype(np.uint64)
    is_word = letter[start]
    out = []
    if is_word.any():
        upper_byte = kind == _UPPER
        upper = np.add.reduceat(upper_byte, start, dtype=np.int64)[is_word]
        # a polynomial in each word's lower-case bytes, scrambled with its length
        low = (data + upper_byte * np.uint8(32)).astype(np.uint64)
        place = np.arange(len(data)) - np.repeat(start, size)
        words = np.add.reduceat(low * _POWER[np.minimum(place, len(_POWER) - 1)], start)[is_word]
        size = size[is_word]
        words = mixed(words + size.astype(np.uint64))
        again = np.zeros(len(words), bool)
        again[1:] = words[1:] == words[:-1]
        title = (upper == 1) & upper_byte[start[is_word]]
        shape[is_word] = np.select([again, upper == 0, (upper == size) & (size > 1), title], [_SHAPE_AGAIN, _SHAPE_LOWER, _SHAPE_UPPER, _SHAPE_TITLE], _SHAPE_MIXED)
        out += [bucket(words), bucket(words[:-1] * _PAIR + words[1:])]
    shape = np.concatenate([[np.uint64(_BEGIN)], shape[shape != 32], [np.uint64(_END)]])
    key = np.zeros(len(shape) + 1, np.uint64)
    for n in range(1, min(SHAPES, len(shape)) + 1):
        key = key[:-1] * np.uint64(512) + shape[n - 1 :]
        out.append(bucket(mixed(key + np.uint64(n << 60))))
    return np.concatenate(out)


def features(text: bytes) -> np.ndarray:
    """The sorted distinct buckets of a text's n-grams."""
    return np.unique(grams(text))


@dataclass
class Model:
    ratio: np.ndarray  #: log-count ratio of each bucket, 0 of those not kept
    weight: np.ndarray  #: of each bucket's scaled indicator
    bias: float
    slope: float  #: of the logistic curve of the margin
    shift: float


def hinge(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, n: int, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Weights of least |w|^2 / 2 + sum of cost * max(0, 1 - y w.x), and the duals, by dual coordinate descent. Row i has values[i] at rows[i]."""
    rng, w, alpha = np.random.default_rng(SEED), np.zeros(n), np.zeros(len(rows))
    square = [float(v @ v) for v in values]
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)).tolist():
            if not square[i]:
                continue
            at, v = rows[i], values[i]
            slope = y[i] * float(w[at] @ v) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if new != alpha[i]:
                most = max(most, abs(new - alpha[i]) / cost[i])
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if most < 1e-3:
            break
    return w, alpha


def curve(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (0 or more) and shift of the likeliest logistic curve, labels smoothed as if one more text of each were seen."""
    n1, n0 = label.sum(), (1 - label).sum()
    aim = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        g, h = p - aim, np.maximum(p * (1 - p), 1e-9)
        hess = np.array([[(h * margin * margin).sum() + 1e-6, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hess, [(g * margin).sum(), g.sum()])
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return max(0.0, float(a)), float(b)


def sample_of(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(h, label, grams) of the labelled sample: a row for each different text, with its features."""
    one = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label is not null").where(~held_out("id"))
    one = one.groupBy("id").agg(F.min("label").alias("label"))
    bodies = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    texts = common.cut(bodies.select("id", "h").join(one, "id").groupBy("h").agg(F.min("label").alias("label")))
    share = min(1.0, FIT_DOCS / max(1, texts.count()))
    few = F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30))
    # some FIT_DOCS hashes and labels are broadcast; only texts of the sample move
    rows = bodies.where(few).select("h", "text").join(F.broadcast(texts.where(few)), "h").groupBy("h").agg(F.min(F.struct("label", "text")).alias("x"))

    def run(batches):
        for batch in batches:
            found = [features(t) for t in batch.column(2).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.list_(pa.int32()))], names=["h", "label", "grams"])

    return common.arrow(rows.select("h", "x.label", "x.text"), run, "h long, label int, grams array<int>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> Model | float:
    """The model of label 1 against 0; a score for all documents if the labels know one side only."""
    rows = common.cut(sample_of(docs, labels, id_col, text, label).where("label in (0, 1)"))
    n1, n = rows.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    n0 = n - n1
    if not n1 or not n0:
        return 0.5 if not n else float(n1 > 0)
    counts = rows.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.sum("label").alias("n1"))
    p = F.col("n") / F.lit(n)
    z = F.abs(F.col("n1") / n1 - (F.col("n") - F.col("n1")) / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    kept = counts.where(F.col("n") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "gram").limit(VOCABULARY).toPandas()
    ratio, weight = np.zeros(BUCKETS), np.zeros(BUCKETS)
    if not len(kept):
        return n1 / n
    gram, one = kept["gram"].to_numpy(np.int64), kept["n1"].to_numpy(float) + 1
    zero = kept["n"].to_numpy(float) - kept["n1"].to_numpy(float) + 1
    ratio[gram] = np.log(one / one.sum() * zero.sum() / zero)
    known = rows.sparkSession.sparkContext.broadcast(np.isin(np.arange(BUCKETS), gram))

    def run(batches):
        for batch in batches:
            few = [np.asarray(g, np.int64)[known.value[np.asarray(g, np.int64)]] for g in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(few, pa.list_(pa.int32()))], names=["h", "label", "grams"])

    few = common.arrow(rows, run, "h long, label int, grams array<int>").toArrow().sort_by("h").combine_chunks()
    y = few["label"].to_numpy() * 2.0 - 1
    flat, ends = np.asarray(few["grams"].combine_chunks().flatten()), np.asarray(few["grams"].combine_chunks().offsets)
    to = np.zeros(BUCKETS, np.int64)
    to[gram] = np.arange(len(gram))
    at = [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    values = [scaled(ratio[g]) for g in at]
    # the last column is the bias
    rows_at = [np.append(to[g], len(gram)) for g in at]
    values = [np.append(v, 1.0) for v in values]
    cost = COST * np.sqrt(len(y) / 2 / np.where(y > 0, n1, n0))  # the rarer label weighs more, by a root
    aside = np.arange(len(y)) % 5 == 0
    if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
        aside[:] = False
    learn = np.flatnonzero(~aside)
    w, _ = hinge([rows_at[i] for i in learn], [values[i] for i in learn], y[learn], len(gram) + 1, cost[learn])
    seen = np.flatnonzero(aside) if aside.any() else learn
    slope, shift = curve(np.array([w[rows_at[i]] @ values[i] for i in seen]), (y[seen] + 1) / 2)
    weight[gram] = w[:-1]
    return Model(ratio, weight, float(w[-1]), slope, shift)


def scaled(x: np.ndarray) -> np.ndarray:
    return x / max(1e-12, float(np.sqrt(x @ x)))


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def told(body: bytes | None) -> float:
        m = sent.value
        if isinstance(m, float):
            return m
        at = grams(body or b"")
        at = np.unique(at[m.ratio[at] != 0])
        r = m.ratio[at]
        margin = float(m.weight[at] @ scaled(r)) + m.bias
        return float(1 / (1 + np.exp(-np.clip(m.slope * margin + m.shift, -40, 40))))

    def run(batches):
        common.kept("quality", None)
        for batch in batches:
            bodies = batch.column(1).cast(pa.large_string()).cast(pa.large_binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([told(b.as_py()) for b in bodies], pa.float64())], names=[id_col, "score"])

    rows = docs.select(id_col, text)
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
