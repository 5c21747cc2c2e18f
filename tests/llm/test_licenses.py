"""Operator 8: base columns against a word-by-word version, rules and their resolution."""

import random
import re

import pytest

from tessera.llm import licenses as L

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def base(text):
    words = WORDS.findall((text or "").translate(LOWER))
    at = [(i, label) for phrase, label in L.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


def test_base_columns(spark):
    rng = random.Random(2)
    bits = ["GNU General Public License", "mit", "License", "license.", "CC", "by", "-", "\n", "Apache", "é", "ÉMIT", "\x80", "3", "mit license mit license", "accby", "cc by-nc", "gnu general public licenses", "\U0001f600", "İ"]
    texts = [None, "", "!!", "MIT License", "permit license", "cc\tby"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 25))) for _ in range(300)]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t), t
        assert 0 <= r.score <= 1 and {x for x in r.base_labels.split(",") if x} <= set(r.labels.split(","))


@pytest.mark.parametrize(("words", "labels"), [
    ("licensed under the apache license version 2 0", ["apache"]), ("spdx license identifier gpl 3 0 or later", ["gpl"]), ("licensed under the gnu lesser general public license", ["lgpl"]),
    ("released under cc by nc sa 4 0", ["cc-by-nc-sa"]), ("licensed under cc by", ["cc-by"]), ("permission is hereby granted free of charge to any person obtaining a copy", ["mit"]), ("all rights reserved", ["proprietary"]),
    ("the river was wide", []), ("distributed under the boost software license", ["boost"]), ("licensed under the mozilla public license and released under the mit license", ["mpl", "mit"]),
])
def test_rules(words, labels):
    assert [d[2] for d in L.detected(words, L.word_ends(words))] == labels


def test_there_are_hundreds_of_rules_and_gates_lose_none():
    assert len(L.rules()) > 300
    every = sorted({label for _, label, *_ in L.rules()})
    assert "gpl" in every and all(any(k in p.pattern or k in "licen release distribut publish availab provid cover offer terms conditions provisions version spdx" for k in keys) for p, _, _, _, keys in L.rules())


def test_containment():
    words = "licensed under the gnu affero general public license version 3"
    kept = L.detected(words, L.word_ends(words))
    assert [(k[0], k[1], k[2]) for k in kept] == [(0, 10, "agpl")]


def test_odd_rows(odd, empty):
    got = L.scan(odd)
    assert got.count() == odd.count() and L.scan(empty).count() == 0 and not got.where("n_base > 0").count()


def test_words_apart(spark):
    """Whole texts whose only key words have more than one separator between them."""
    texts = ["CC - BY 4.0", "cc,\n by", "cc  by", "CC\n\nBY", "x cc (by)", "placed in the public -- domain", "cc", "by"]
    rows = {r.doc_id: r for r in L.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    for i, t in enumerate(texts):
        assert (rows[i].n_words, rows[i].n_base, rows[i].first_word, rows[i].last_word, rows[i].base_labels) == base(t), t
    assert [rows[i].n_base for i in range(8)] == [1, 1, 1, 1, 1, 0, 0, 0] and rows[5].labels == "public-domain"


def matches_of(pattern):
    """Texts that together take every alternative of a pattern once at least, with optional parts and without."""
    from re import _constants as C
    from re import _parser as P

    def of(items):
        out = [""]
        for op, arg in items:
            if op is C.LITERAL:
                part = [chr(arg)]
            elif op is C.IN:
                part = [chr(v) if o is C.LITERAL else "3" if v is C.CATEGORY_DIGIT else "u" for o, v in arg]
            elif op is C.SUBPATTERN:
                part = of(arg[3])
            elif op is C.BRANCH:
                part = [x for b in arg[1] for x in of(b)]
            elif op is C.MAX_REPEAT:
                part = [x for x in dict.fromkeys([*[""] * (arg[0] == 0), *of(arg[2])])]
            else:
                assert op is C.ASSERT_NOT, op
                continue
            n = max(len(out), len(part))
            out = [a + b for a in out for b in part] if len(out) * len(part) <= 400 else [out[i % len(out)] + part[i % len(part)] for i in range(n)]
        return out

    return of(P.parse(pattern))


def test_gates_lose_nothing_that_a_rule_matches():
    n = 0
    for pattern, label, *_, keys in L.rules():
        for words in matches_of(pattern.pattern):
            assert pattern.search(words), (pattern.pattern, words)
            assert any(L.is_open(k, words, set(words.split(" "))) for k in keys), (label, words)
            apart = words.replace(" ", "  ").encode()
            assert L.may_match(apart, apart.split()), words
            n += 1
    assert n > 3000


@pytest.mark.parametrize(("text", "labels"), [
    ("GPL v3", "gpl"), ("MPL - v2.0", "mpl"), ("LGPL v2.1 or later", "lgpl"), ("GPL v ٣", "gpl"), ("GNU Affero General Public License", "agpl"), ("Mozilla Public License", "mpl"),
    ("Creative Commons Attribution ShareAlike", "cc-by-sa"), ("CC0", "cc0"), ("the Unlicense", "unlicense"), ("Public Domain Dedication and License", "pddl"), ("BSD 3-Clause License", "bsd-3-clause"), ("see v3 of it", ""),
])
def test_names_and_versions_alone(spark, text, labels):
    assert L.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().labels == labels


def test_many_phrases_in_one_text(spark):
    """Work is in proportion to the matches: places, containment and covered words alike."""
    text = "mit license " * 16_000
    row = L.scan(spark.createDataFrame([(1, text), (2, "CC - BY, " * 9)], "doc_id int, text string")).orderBy("doc_id").collect()[0]
    assert (row.n_words, row.n_base, row.first_word, row.last_word) == base(text)[:4] and row.labels == "mit"


def test_uncontained_against_all_pairs():
    rng = random.Random(1)
    for _ in range(300):
        found = [(rng.randrange(3), a := rng.randrange(30), a + 1 + rng.randrange(9)) for _ in range(25)]
        found.sort(key=lambda f: (f[0], f[1] - f[2], f[1]))
        kept = []
        for f in found:
            if not any(k[1] <= f[1] and f[2] <= k[2] for k in kept):
                kept.append(f)
        assert L.uncontained(found) == kept


@pytest.mark.parametrize(("text", "label"), [
    ("GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "gpl-2.0-or-later"),
    ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "cc-by-nc-sa-4.0"), ("GPL with Classpath exception", "classpath-exception"), ("Neither the name of X nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements", "apache-2.0"), ("under the same terms as Perl itself", "perl"), ("For evaluation purposes only", "evaluation"), ("The Software shall be used for Good, not Evil.", "json"), ("W3C Software Notice and License", "w3c"), ("Zope Public License (ZPL) Version 2.1", "zpl"),
])
def test_notices(spark, text, label):
    assert label in L.scan(spark.createDataFrame([(1, text)], "doc_id int, text string")).first().labels.split(",")
