"""Operator 4: the fit's gradient, held-out accuracy, odd rows."""

import numpy as np

from tessera.llm import toxicity as X


def test_fit_recovers_order():
    rng = np.random.default_rng(1)
    rows, grades = [], []
    for _ in range(3000):
        k = rng.integers(0, 4)
        rows.append(np.unique(rng.integers(0, 6, k)))
        s = sum((3.0, 1.0, 0.0, 0.0, -1.0, 2.0)[i] for i in rows[-1]) / max(1, len(rows[-1])) ** 0.5 + rng.logistic()
        grades.append(int(s > 1) + int(s > 3))
    w, cut = X.fit_ordinal(rows, np.array(grades), 6)
    assert cut[0] < cut[1] and w[0] > w[5] > w[1] > w[4] and abs(cut[0] - 1) < 0.4 and abs(cut[1] - 3) < 0.5 and abs(w[0] - 3) < 0.6


def test_features():
    assert X.features("Bastante bastardo, BASTANTE 3x") == {"bastante", "bastardo", "x", "^basta", "^bastan", "^bastar", "^bastant", "^bastard", "^^basta"}
    assert X.features("bastante bastardo", frozenset(["bastar"])) == {"bastante", "bastardo", "^bastar"} and X.features("") == set()


def planted(spark, n=600):
    rng = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [plain[j] for j in rng.integers(0, 300, rng.integers(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            w[rng.integers(0, len(w))] = ("vilething", "nastyone", "vilestuff")[i // 15 % 3]
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 10 != 0), int(toxic)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = planted(spark)
    model = X.fit(docs, labels.where("doc_id % 3 <> 1"))
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    rest = [i for i in range(600) if i % 3 == 1]
    assert all(got[i].toxic == (i % 5 == 0) for i in rest)
    assert all(0 <= r.severity <= 2 and 0 <= r.p_toxic <= 1 for r in got.values())
    mean = lambda k: np.mean([got[i].severity for i in rest if i % 5 == 0 and (i % 10 == 0) == k])
    assert mean(True) > 0.5 and mean(False) > 0.5


def test_odd_rows(spark, odd, empty):
    docs, labels = planted(spark)
    model = X.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 1), (2, None, 1), (10**9, 1, 1), (5, 1, 1), (5, 0, 0)], labels.schema)))
    got = X.score(odd, model)
    assert got.count() == odd.count() and not got.where("toxic").count() and X.score(empty, model).count() == 0
    assert X.fit(docs, labels.where("toxic = 0")) is None and X.fit(docs, labels.where("false")) is None
    assert {r.severity for r in X.score(odd, None).collect()} == {0.0}


def plain_features(text):
    words = {w for w in "".join(c if c.isalpha() else " " for c in text.lower()).split()}
    out = set(words)
    for k in X.PREFIXES:
        for w in words:
            if len(w) > k:
                out.add("^" + w[:k])
                if any(v != w and len(v) > k and v[:k] == w[:k] for v in words):
                    out.add("^^" + w[:k])
    return out


def test_against_a_plain_version(spark):
    """Kept features by their z-scores, weights and thresholds by the likelihood's own slope, severity by the model's formula."""
    docs, labels = planted(spark)
    model = X.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    grade = {r.doc_id: 0 if not r.toxic else 2 - r.quality for r in labels.collect()}
    held = {i: plain_features(t) for i, t in texts.items()}
    bad, n = sum(g > 0 for g in grade.values()), len(grade)
    kept = {}
    for f in set().union(*held.values()):
        has = [i for i in held if f in held[i]]
        k, p = sum(grade[i] > 0 for i in has), len(has) / n
        z = (k / bad - (len(has) - k) / (n - bad)) / (p * (1 - p) * (1 / bad + 1 / (n - bad)) + 1e-12) ** 0.5
        if len(has) >= X.LEAST_DOCS and z >= X.LEAST_Z:
            kept[f] = z
    assert set(model.words) == set(kept) and len(kept) >= 6
    ranked = [kept[w] for w in sorted(model.words, key=model.words.get)]
    assert all(a >= b - 1e-9 for a, b in zip(ranked, ranked[1:], strict=False))

    own = {i: sorted(held[i] & set(kept)) for i in held}
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def loss(weights, cut):
        total = X.PENALTY / 2 * (weights**2).sum()
        for i, fs in own.items():
            s = sum(weights[model.words[f]] for f in fs) / max(1, len(fs)) ** 0.5
            below = [0.0, *(logistic(c - s) for c in cut), 1.0]
            total -= np.log(below[grade[i] + 1] - below[grade[i]])
        return total

    least = loss(model.weights, model.thresholds)
    for k in range(len(model.weights) + 2):
        for h in (-0.1, 0.1):
            w, c = model.weights.copy(), model.thresholds.copy()
            (w if k < len(w) else c)[k if k < len(w) else k - len(w)] += h
            assert loss(w, c) > least - 1e-3, k
    got = {r.doc_id: r for r in X.score(docs, model).collect()}
    for i, fs in own.items():
        s = sum(model.weights[model.words[f]] for f in fs) / max(1, len(fs)) ** 0.5
        above = [1 - logistic(c - s) for c in model.thresholds]
        assert abs(got[i].severity - sum(above)) < 1e-9 and abs(got[i].p_toxic - above[0]) < 1e-9 and got[i].toxic == (above[0] >= X.TOXIC)
