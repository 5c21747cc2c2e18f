"""Operator 3 against the public library, and round trips."""

import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    with open(FILE, "rb") as f:
        ranks = bpe.ranks_of(f.read())
    return bpe.Coder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_texts(pair):
    own, other = pair

    @settings(max_examples=400, deadline=None)
    @given(st.text(st.sampled_from(list("ab e's1.\n\t\r　\x1c\x85éß日ض٣\U0001f600̀")) | st.characters(exclude_categories=["Cs"]), max_size=40))
    def check(text):
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text)
        assert own.decode(ids) == text.encode()

    check()


@pytest.mark.parametrize("alphabet", ["ab", "the", "aaab", "xyz0"])
def test_long_pre_tokens(pair, alphabet):
    rng = random.Random(alphabet)
    for text in ("a" * 5000, "".join(rng.choice(alphabet) for _ in range(30_000))):
        assert pair[0].encode(text) == pair[1].encode_ordinary(text)


def test_memory_is_bounded(pair, monkeypatch):
    own = bpe.Coder(pair[0].ranks, P.PATTERN)
    own.pieces.bounds = own.pre.bounds = (5, 5)
    text = " ".join(f"w{i % 37}x, y{i % 11}" for i in range(500))
    assert own.encode(text) == pair[1].encode_ordinary(text) and max(len(own.pieces.lasting), len(own.pieces.fresh)) <= 5


def test_query(odd, empty, pair):
    rows = {}
    for r in bpe.digests(odd, FILE, P.PATTERN).collect():
        rows.setdefault(r.doc_id, r)
    for r in odd.where("doc_id is not null").collect():
        ids = pair[1].encode_ordinary(r.text or "")
        got = rows[r.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.digests(empty, FILE, P.PATTERN).count() == 0


def test_operators(odd):
    back = bpe.decode(bpe.encode(odd, FILE, P.PATTERN), FILE, P.PATTERN)
    assert sorted(bytes(r.bytes) for r in back.collect()) == sorted((r.text or "").encode() for r in odd.collect())


def test_stage_returns_the_ids(spark, odd, pair):
    out = bpe.stage(spark, odd, "")
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    want = sorted(pair[1].encode_ordinary(r.text or "") for r in odd.collect())
    assert sorted(r.ids for r in out.collect()) == want and out.where("size(ids) <> n_tokens").count() == 0


def test_halves():
    held = bpe.Memory((4, 4))
    for i in range(9):
        held.put(i, i + 1)
        assert held.get(i) == i + 1 and len(held.lasting) <= 4
    assert held.get(0) is None and held.get(8) == 9
