"""Operator 13: the trie against one built in plain Python; long conversations, copies, odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from tessera.llm import prefix_trie as X

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes by the definition, from rows (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append((role or "", text or ""))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    out = []
    for key, members in nodes.items():
        under = [(k, m) for k, m in nodes.items() if k[: len(key)] == key]
        leaf = lambda k: not any(len(x) == len(k) + 1 and x[:-1] == k for x in nodes)
        saved = sum((len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k, m in under if k)
        ends = ",".join(str(c) for c in sorted(members) if built[c] == key)
        kids = sum(len(k) == len(key) + 1 for k, _ in under)
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), kids, sum(leaf(k) for k, _ in under), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows):
    df = X.trie(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert [t for _, t in df.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def conversations(seed, n=60, words=2, longest=6):
    rng = random.Random(seed)
    return [(c, t, "ua"[t % 2], " ".join(rng.choice("x y".split()) for _ in range(rng.randint(0, words)))) for c in range(n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain(spark, seed):
    rows = conversations(seed)
    want = plain(rows)
    assert got(spark, rows) == want and max(r[5] for r in want) > 5 and sum(r[3] > 1 for r in want) > 20


def test_levels_slices_and_pieces(spark, monkeypatch):
    """Long conversations and many copies, with all sizes small: segments of segments, slices of lines, pieces of lists."""
    monkeypatch.setattr(X, "SEGMENT", 3)
    monkeypatch.setattr(X, "SLICE", 4)
    monkeypatch.setattr(X, "PIECE", 2)
    rows = conversations(3, 30)
    text = [f"word {i % 7} {i}" for i in range(40)]
    for c, n in ((100, 40), (120, 40), (140, 40), (160, 31), (180, 17), (200, 17), (220, 40)):  # blocks' first conversations are not rebuilt
        rows += [(c, t, "u", text[t] if t != 22 or c != 220 else "odd one") for t in range(n)]
    assert got(spark, rows) == plain(rows)


def test_stretches_are_few(spark):
    """Two copies of a conversation of 300 turns: its nodes form one stretch, which is not exploded by node."""
    rows = [(c, t, "u", f"t {t}") for c in (0, 20, 40) for t in range(300 if c < 40 else 150)]
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, 1, "u", ""), (0, 1, "u", ""), (0, 1, None, "b a"), (None, 1, "u", "lost"), (None, None, None, None), (3, 5, "u", "one\t two\x0bthree  é"), (4, 0, "u", "x" * 50_000), (7, 2, "a", "2"), (7, None, "a", "null first"), (7, -1, "a", "1")]
    rows += [(c, 0, "u", "only") for c in (21, 22, 23, 24, 25, 26, 27, 28, 29)]  # the block's first is absent, so some have no turn
    want = plain(rows)
    assert got(spark, rows) == want and any(r[1] == 0 and r[7] != hashlib.sha256().hexdigest() for r in want)
    assert got(spark, []) == [] and got(spark, [r for r in rows if r[0] is None]) == []
    assert len(got(spark, rows[:1])) == 2
    named = spark.createDataFrame([(*r, 1, "z", "q", 3) for r in rows], SCHEMA + ", k long, digest string, rep string, depth long")
    assert sorted((tuple(r) for r in X.trie(named).collect()), key=repr) == want
