"""Operator 10: the automaton and the parsing against plain search, and held-out accuracy."""

import random

import numpy as np
import pytest

from tessera.llm import language as G


def plain_phrases(text, training):
    n = i = 0
    while i < len(text):
        k = 1
        while i + k <= len(text) and text[i : i + k] in training:
            k += 1
        i += max(1, k - 1)
        n += 1
    return max(1, n)


def test_cross_parsing():
    rng = random.Random(1)
    for _ in range(60):
        training = "".join(rng.choice("abc") for _ in range(rng.randint(1, 60)))
        texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(5)]
        table = G.automaton([ord(c) - 97 for c in training], 5)
        seq = np.array([ord(c) - 97 for t in texts for c in t], np.uint8)
        got = G.phrases(seq, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), table)
        assert [g for g, t in zip(got, texts, strict=True) if t] == [plain_phrases(t, training) for t in texts if t]


def test_long_texts_are_parsed_in_one():
    """Texts of 5,000 symbols, against a parse that does not cut; such too in which no phrase begins where a segment does."""
    rng = random.Random(9)
    for training in ("".join(rng.choice("abc") for _ in range(300)), "a" * 10 + "b", "ab" * 700, "abc" * 11):
        texts = ["".join(rng.choice("abc") for _ in range(n)) for n in (5000, 512, 513, 0, 1, 1024, 3000)] + ["a" * 5000, "ab" * 2500, "abcd" * 900, "d" * 1500]
        table = G.automaton([ord(c) - 97 for c in training], 5)
        seq = np.array([ord(c) - 97 for t in texts for c in t], np.uint8)
        got = G.phrases(seq, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), table)
        assert got.tolist() == [plain_phrases(t, training) if t else 0 for t in texts]


def test_model_is_bounded(spark, monkeypatch):
    """However many languages there are, they share the sample; more than can be learned are an error."""
    import json

    monkeypatch.setattr(G, "SAMPLE_TOTAL", 3000)
    docs = corpus(spark)
    model = json.loads(G.fit(docs))
    assert len(model) == 3 and all(900 < len(t) < 1700 for t in model.values())
    assert sum(r.lang == r.lang_pred for r in G.predict(docs, json.dumps(model), also=("lang",)).collect()) > 230
    monkeypatch.setattr(G, "MOST_LANGS", 2)
    with pytest.raises(ValueError, match="3 languages"):
        G.fit(docs)


def test_symbols():
    codes, offsets = G.symbols(["Ab, c!", "", " é", "1"])
    assert "".join(chr(c or 32) for c in codes) == "ab c é" and offsets.tolist() == [0, 5, 5, 6, 6]


def corpus(spark, n=240):
    rng = random.Random(3)
    syllables = {"x": ["th", "er", "in", "ly", "sh"], "y": ["ou", "eau", "que", "é", "le"], "z": ["sch", "ung", "ei", "tz", "ö"]}
    rows = []
    for i in range(n):
        lang = "xyz"[i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 80))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out(spark):
    docs = corpus(spark)
    got = G.predict(docs, G.fit(docs.where(~G.held_out())), also=("lang",))
    rows = got.where(G.held_out()).collect()
    assert len(rows) > 50 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark, odd, empty):
    docs = corpus(spark)
    model = G.fit(docs.unionByName(spark.createDataFrame([(900, None, "x"), (901, "th", None)], docs.schema)))
    got = {}
    for r in G.predict(odd, model).collect():
        got.setdefault(r.doc_id, r)
    assert [got[i].lang_pred for i in (3, 4, 7, 8)] == ["und"] * 4 and got[3].score == 0 and got[9].lang_pred != "und"
    assert G.predict(empty, model).count() == 0
    none = G.fit(docs.where("false"))
    assert {r.lang_pred for r in G.predict(odd, none).collect()} == {"und"}


def test_training_is_bounded_and_blind(spark, monkeypatch):
    monkeypatch.setattr(G, "SAMPLE_DOCS", 5)
    docs = corpus(spark)
    same = docs.selectExpr("doc_id + 7 as doc_id", "text", "lang").repartition(3)
    assert G.fit(docs) == G.fit(same) and len(G.fit(docs)) < 6000


def test_stage(spark, odd):
    out = G.stage(spark, odd, "")
    assert out.columns == odd.columns and out.where("text is null or doc_id = 8").count() == 0 and out.where("doc_id in (1, 6, 12)").count() == 4


def test_scripts_of_thousands_of_letters(spark):
    """Two languages of 300 Chinese signs each, and a script never learned; more languages than 64."""
    rng = random.Random(5)
    signs = {"p": range(0x4E00, 0x4F2C), "q": range(0x6000, 0x612C)}
    words = {k: ["".join(chr(rng.choice(v)) for _ in range(2)) for _ in range(80)] for k, v in signs.items()}
    rows = [(i, "".join(rng.choice(words["pq"[i % 2]]) for _ in range(60)), "pq"[i % 2]) for i in range(80)]
    rows += [(1000 + 3 * i + j, f"{chr(0xAC00 + 2 * i)}{chr(0xAC01 + 2 * i)}" * 9, f"r{i:02}") for i in range(70) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    new = spark.createDataFrame([(-1, "".join(chr(rng.randrange(0x8000, 0x8400)) for _ in range(200)), None), (-2, rows[-1][1], "r69"), (-3, rows[-211][1], rows[-211][2])], docs.schema)
    got = {r.doc_id: r for r in G.predict(docs.unionByName(new), G.fit(docs), also=("lang",)).collect()}
    assert all(r.lang == r.lang_pred for i, r in got.items() if i != -1) and got[-1].rate == 1


def test_sparse_transitions():
    rng = random.Random(6)
    seq, new = [rng.randrange(9) for _ in range(500)], np.array([rng.randrange(10) for _ in range(900)])
    offsets = np.array([0, 0, 7, 600, 900])
    assert G.phrases(new, offsets, G.automaton(seq, 10, 0)).tolist() == G.phrases(new, offsets, G.automaton(seq, 10)).tolist()
