"""Operator 12: n-grams, the fit's optimum, held-out accuracy, odd rows."""

import numpy as np

from tessera.llm import quality as X


def test_grams():
    same = lambda a, b: np.array_equal(X.features(a.encode()), X.features(b.encode()))
    assert len(X.features(b"")) == 3  # begin, end, both
    assert same("One two", "Six ten") is False and same("a  b", "a b") and same("x ### y", "x # y") and not same("x ## y", "x #! y")
    assert not same("one two", "one One") and not same("one one", "one two") and not same("ONE", "One")
    words = lambda t: set(X.features(t.encode()).tolist())
    assert len(words("alpha beta") & words("BETA; Alpha")) >= 2  # words count alike in either case
    long = ("é" * 5000 + " ") * 2
    assert len(X.features(long.encode())) > 3


def test_shapes_against_plain():
    """The n-grams of shapes of a text without words are those of its characters."""
    text = "!?!!-?"
    runs = [258 + 3, *map(ord, "!?!-?"), 262]
    want = set()
    for n in range(1, X.SHAPES + 1):
        for i in range(len(runs) - n + 1):
            key = 0
            for s in runs[i : i + n]:
                key = key * 512 + s
            want.add(int(X.bucket(X.mixed(np.array([(key + (n << 60)) % (1 << 64)], np.uint64)))[0]))
    assert set(X.features(text.encode()).tolist()) == want


def test_hinge_reaches_the_optimum():
    """The gap between the primal and the dual objective closes."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 8))
    y = np.sign(x @ rng.normal(size=8) + rng.normal(size=300) * 0.5)
    cost = np.full(300, 0.7)
    w, alpha = X.hinge([np.arange(8)] * 300, list(x), y, 8, cost, epochs=400)
    primal = w @ w / 2 + (cost * np.maximum(0, 1 - y * (x @ w))).sum()
    dual = alpha.sum() - w @ w / 2
    assert np.allclose(w, (alpha * y) @ x) and ((alpha >= 0) & (alpha <= cost)).all()
    assert dual <= primal < dual * 1.01


def test_curve():
    rng = np.random.default_rng(6)
    m = rng.normal(size=20_000) * 2
    label = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * m + 0.4)))).astype(float)
    a, b = X.curve(m, label)
    assert abs(a - 1.5) < 0.1 and abs(b - 0.4) < 0.1


def planted(spark, n=900):
    rng = np.random.default_rng(2)
    plain = [f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(100)]
    docs, labels = [], []
    for i in range(n):
        w = [plain[j] for j in rng.integers(0, 100, rng.integers(8, 60))]
        bad = i % 4 == 0
        if bad:
            w = [[x + "###" for x in w], [x.upper() for x in w], [w[0]] * len(w), [*w, "buynow", "cheap"]][i // 4 % 4]
        docs.append((i, " ".join(w)))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out(spark):
    docs, labels = planted(spark)
    model = X.fit(docs, labels)
    rows = X.score(docs, model).select("doc_id", "score", X.held_out().alias("held")).collect()
    rest = [r for r in rows if r.held]
    right = [(r.score >= 0.5) == (r.doc_id % 4 != 0) for r in rest]
    assert len(rest) > 200 and np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    # labels of held-out rows are never read
    turned = labels.withColumn("quality", X.F.when(X.held_out(), 1 - X.F.col("quality")).otherwise(X.F.col("quality")))
    again = X.fit(docs, turned)
    assert np.array_equal(again.weight, model.weight) and (again.slope, again.shift) == (model.slope, model.shift)


def test_ratio_against_plain(spark):
    docs, labels = planted(spark, 200)
    model = X.fit(docs, labels)
    kept = np.flatnonzero(model.ratio)
    text, lab = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.quality for r in labels.where(~X.held_out()).collect()}
    grams = {i: set(X.features(text[i].encode()).tolist()) for i in lab}
    one = np.array([1 + sum(lab[i] == 1 and g in grams[i] for i in lab) for g in kept.tolist()])
    zero = np.array([1 + sum(lab[i] == 0 and g in grams[i] for i in lab) for g in kept.tolist()])
    assert len(kept) > 10 and np.abs(np.log(one / zero) - model.ratio[kept]).std() < 1e-9 + np.log(2) and np.ptp(np.log(one / zero) - model.ratio[kept]) < 1e-6


def test_odd_rows(spark, odd, empty):
    docs, labels = planted(spark)
    more = spark.createDataFrame([(None, 1, 1), (2, None, 1), (10**9, 1, 1), (5, 1, 1), (5, 0, 0), (6, 7, 0)], labels.schema)
    model = X.fit(docs, labels.unionByName(more))
    got = X.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got) and X.score(empty, model).count() == 0
    blank = X.score(odd.where("coalesce(text, '') = ''"), model).collect()
    assert len({r.score for r in blank}) == 1
    assert X.fit(docs, labels.where("quality = 1")) == 1.0 and X.fit(docs, labels.where("quality = 0")) == 0.0 and X.fit(docs, labels.where("false")) == 0.5
    assert X.fit(empty, labels) == 0.5 and {r.score for r in X.score(odd, 0.5).collect()} == {0.5}
    named = odd.selectExpr("concat('d', doc_id) as name", "text as body", "doc_id as text")
    assert X.score(named, model, "name", "body").count() == odd.count()
