"""Operator 11: treaps, pruning and ranks against exhaustive scoring, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tessera.llm import lexical as X


def plain(docs, items, k=10):
    """Scores of every document, by the definition."""
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(fold(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in fold(text) if t in c)
            scored.append((-score, i is None, 0 if i is None else i))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(x for x in scored if x[0] < 0)[:k], 1)]
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_terms():
    assert X.terms(b"The CAT_s") == [b"the", b"cat", b"s"]
    assert [t.decode() for t in X.terms("éÀ2x--Ünï\x00日本".encode())] == ["éÀ2x", "Ünï", "日本"] and X.terms(b"") == []


@pytest.mark.parametrize("shape", ["random", "equal", "rising"])
def test_treaps(shape):
    rng = np.random.default_rng(3)
    term = np.repeat(np.arange(5), [400, 1, 0, 90, 1000])
    place = np.concatenate([np.sort(rng.choice(2000, n, replace=False)) for n in (400, 1, 0, 90, 1000)])
    impact = {"random": rng.integers(1, 1 << 34, len(term)), "equal": np.full(len(term), 7), "rising": place + 1}[shape]
    shuffled = rng.permutation(len(term))
    t = X.Treaps(term[shuffled], place[shuffled], impact[shuffled], 5)
    assert t.roots[2] == t.none
    deep = 0
    for k in (0, 1, 3, 4):
        stack, seen = [(t.roots[k], -1, 1 << 30, 1 << 60, 1)], []
        while stack:
            x, lo, hi, most, depth = stack.pop()
            if x == t.none:
                continue
            assert lo < t.place[x] < hi and t.impact[x] <= most
            deep = max(deep, depth)
            seen.append((t.place[x], t.impact[x]))
            stack += [(t.left[x], lo, t.place[x], t.impact[x], depth + 1), (t.right[x], t.place[x], hi, t.impact[x], depth + 1)]
        assert sorted(seen) == sorted(zip(place[term == k], impact[term == k], strict=True))
    assert deep < 40 or shape == "rising"


def test_pruning_keeps_the_best_and_skips_most():
    rng = np.random.default_rng(5)
    n, sizes = 8000, (6000, 3000, 400, 60, 12)
    term = np.repeat(np.arange(5), sizes)
    place = np.concatenate([np.sort(rng.choice(n, s, replace=False)) for s in sizes])
    impact = np.concatenate([rng.integers(1, 40, s) * w for s, w in zip(sizes, (1, 3, 20, 90, 300), strict=True)])
    t = X.Treaps(term, place, impact, 5)
    times = np.array([2, 1, 1, 1, 3])
    total = np.bincount(place, impact * times[term], n).astype(int)
    want = sorted((-s, p) for p, s in enumerate(total.tolist()) if s)[:10]
    seen = []
    assert X.best_of(t, np.arange(5), times, n, 10, (0, 0), seen) == want
    assert sum(seen) < n / 4
    # with a bar, what does not beat it may be missing, what does is there
    got = X.best_of(t, np.arange(5), times, n, 10, want[4])
    assert got[:4] == want[:4]


def corpus(n=700):
    rng = np.random.default_rng(8)
    word = lambda: f"w{int(rng.zipf(1.4)) % 500}"
    docs = [(i, " ".join(word() for _ in range(rng.integers(1, 60)))) for i in range(n)]
    docs += [(n + i, docs[3][1]) for i in range(150)]  # copies: equal scores
    return docs, [(i, docs[i * 7][1] + " w1 w1 W2") for i in range(30)]


def test_against_plain(spark, monkeypatch):
    docs, items = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    want = plain(docs, items)
    assert rows(X.search(d, i)) == want
    # blocks of queries
    monkeypatch.setattr(X, "BLOCK_TERMS", 100)
    assert rows(X.search(d, i)) == want


def test_shards_carry_their_best(spark, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(X, "SHARD_DOCS", 50)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    held = X.counted(d, spark.sparkContext.broadcast({b"w1": 0, b"w2": 1}), "doc_id", "text")
    assert held.where("n < 1").count() == 0 and held.selectExpr("sum(n)").first()[0] == sum(len(t.split()) for _, t in docs)
    assert rows(X.search(d, spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_odd_rows(spark, odd, empty):
    items = [(1, "The river, the STONE"), (1, "The river, the STONE"), (1, "light one"), (None, "日本 Ünïcödé x"), (2, None), (3, ""), (4, "nowhere"), (5, "one " * 50)]
    asked = spark.createDataFrame([(*i, "z") for i in items], "item_id long, text string, doc_id string")
    docs = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert rows(X.search(odd, asked)) == plain(docs, [i for i in items if i[1]])
    assert X.search(empty, asked).count() == 0 and X.search(odd, asked.where("false")).count() == 0
    named = odd.selectExpr("concat('d', doc_id) as doc_id", "text")
    assert {r.doc_id for r in X.search(named, asked.where("item_id = 5")).collect()} == {"d10", "d11"}
