"""Operator 4: toxicity by cumulative-link ordinal regression.

Grades: 0 not toxic, 1 toxic in a text of good quality, 2 toxic in one of poor quality: labels hold no severity of their own, so the
label of quality stands for it; whether a document is called toxic depends on the first threshold alone. The proportional-odds model has one
weight per word feature, shared by all thresholds: P(grade <= j) = sigmoid(threshold_j - w.x). Features are the presence of
words, of a word that begins with a stem of PREFIXES letters, and of two different such words, which toxic labelled
documents hold far more often than others; a document's features are scaled to length one. The expected
severity is the sum over j of P(grade > j), from 0 to 2; a document is toxic if P(grade > 0) is TOXIC or more.

Features of the labelled sample (about FIT_DOCS documents by id hash, all if fewer) are made and counted in Spark; only the
vocabulary and the sample's few kept features per document come to the driver, where the model is fitted.

Defined results: null and empty texts have no features and get the model's base severity. Labels that are null, or that
belong to no document, are not learned from; an id labelled twice counts by its highest grade. Rows are scored each on
its own; other columns are ignored. Without both toxic and other labels every document gets severity 0. An empty table
gives an empty result.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FIT_DOCS = 20_000  #: expected labelled documents of the fit
VOCABULARY = 1000  #: features kept, by the z-score of their association
LEAST_DOCS = 5  #: labelled texts that have a kept feature
LEAST_Z = 5.0
PREFIXES = (5, 6, 7)
TOXIC = 0.4
GRADES = 3
PENALTY = 0.05  #: of squared weights
WORD = re.compile(r"[^\W\d_]+")


def features(text: str, stems: frozenset[str] | None = None) -> set[str]:
    """Words of text, ^stem for each stem of a longer word, ^^stem where two different words have it; of stems only these, unless None."""
    words = set(WORD.findall(text.lower()))
    once, twice = set(), set()
    for k in PREFIXES:
        for s in [w[:k] for w in words if len(w) > k and (stems is None or w[:k] in stems)]:
            (twice if s in once else once).add(s)
    return words.union(["^" + s for s in once], ["^^" + s for s in twice])


@dataclass
class Model:
    words: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(rows: list[np.ndarray], grades: np.ndarray, n_words: int, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of greatest penalised likelihood, by Adam on all rows. Thresholds stay ordered: the gaps are exponentials."""
    who = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    what = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    norm = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))
    w = np.zeros(n_words)
    share = np.clip(np.cumsum(np.bincount(grades, minlength=GRADES))[:-1] / max(1, len(grades)), 1e-4, 1 - 1e-4)
    cut = np.log(share / (1 - share))
    free = np.concatenate([cut[:1], np.log(np.maximum(np.diff(cut), 1e-2))])
    at = [np.zeros_like(x) for x in (w, free)] + [np.zeros_like(x) for x in (w, free)]
    for t in range(1, steps + 1):
        cut = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(who, w[what], len(rows)) * norm
        full = np.concatenate([[-np.inf], cut, [np.inf]])
        high, low = sigmoid(full[grades + 1] - score), sigmoid(full[grades] - score)
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high) / p, low * (1 - low) / p
        g_w = np.bincount(what, ((d_high - d_low) * norm)[who], n_words) + PENALTY * w
        g_cut = np.bincount(grades, -d_high, GRADES)[:-1] + np.bincount(grades, d_low, GRADES)[1:]
        rest = np.cumsum(g_cut[::-1])[::-1]
        g_free = np.concatenate([rest[:1], rest[1:] * np.exp(free[1:])])
        for i, (x, g) in enumerate(((w, g_w), (free, g_free))):
            at[i] = 0.9 * at[i] + 0.1 * g
            at[i + 2] = 0.99 * at[i + 2] + 0.01 * g * g
            x -= 0.1 * (at[i] / (1 - 0.9**t)) / (np.sqrt(at[i + 2] / (1 - 0.99**t)) + 1e-9)
    return w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text") -> Model | None:
    """The model, or None if the labels know one side only."""
    graded = labels.select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 0, 0).when(F.col("quality") == 0, 2).otherwise(1).alias("grade"), "toxic", "quality").where("id is not null and toxic is not null and quality is not null")
    graded = graded.groupBy("id").agg(F.max("grade").alias("grade"))
    share = min(1.0, FIT_DOCS / max(1, graded.count()))
    sample = graded.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    # copies of one text count once
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(sample, "id").groupBy(F.xxhash64("text").alias("h")).agg(F.max(F.struct("grade", "text")).alias("x"))

    def run(batches):
        for batch in batches:
            words = pa.array([sorted(features(t)) for t in common.texts_of(batch.column(1))], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["grade", "words"])

    rows = common.cut(common.arrow(rows.select("x.grade", "x.text"), run, "grade int, words array<string>"))
    n = {r.toxic: r["count"] for r in rows.groupBy((F.col("grade") > 0).alias("toxic")).count().collect()}
    bad, good = n.get(True, 0), n.get(False, 0)
    if not bad or not good:
        return None
    counts = rows.select("grade", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("grade") > 0).alias("bad"))
    p = F.col("n") / F.lit(bad + good)
    z = (F.col("bad") / bad - (F.col("n") - F.col("bad")) / good) / F.sqrt(p * (1 - p) * (1 / bad + 1 / good) + 1e-12)
    kept = counts.where(F.col("n") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(VOCABULARY).collect()
    index = {r.word: i for i, r in enumerate(kept)}
    if not index:
        return None
    few = rows.select("grade", F.array_intersect("words", F.array(*map(F.lit, index))).alias("words")).collect()
    weights, thresholds = fit_ordinal([np.array([index[w] for w in r.words], np.int64) for r in few], np.array([r.grade for r in few]), len(index))
    return Model(index, weights, thresholds)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id_col, severity (expected grade, 0 to 2), p_toxic, toxic."""
    known = {w: float(model.weights[i]) for w, i in model.words.items()} if model else {}
    cut = model.thresholds if model else np.full(GRADES - 1, np.inf)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        weights, names = sent.value, frozenset(sent.value)
        stems = frozenset(w.lstrip("^") for w in names if w[0] == "^")
        for batch in batches:
            held = [names.intersection(features(t, stems)) for t in common.texts_of(batch.column(1))]
            sums = np.array([sum(weights[w] for w in h) / max(1, len(h)) ** 0.5 for h in held], np.float64)
            above = 1 - sigmoid(cut[None] - sums[:, None]) if model else np.zeros((len(sums), GRADES - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= TOXIC)], names=[id_col, "severity", "p_toxic", "toxic"])

    rows = docs.select(id_col, text)
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, severity double, p_toxic double, toxic boolean")


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))
