"""Operator 3: byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token starts as a linked list of bytes. Each adjacent pair that is in the vocabulary is queued under its rank: a
bucket per rank holds list positions, a bitmap of two levels (256 ranks a word, one word over all words) tells which
buckets are not empty. Find-first-set picks the lowest rank, its leftmost position is merged, and the pairs left and right
of the new token are queued. An entry whose position has meanwhile changed is stale and skipped. A merge costs the same
however long the pre-token is.

Texts are cut at spaces that have no other white space beside them: there the pattern always ends a match, so pieces
between such spaces are encoded once and remembered, in a bounded memory whose older half goes when it is full.

Defined results: a null text counts as empty and has no ids; every row is encoded on its own, repeats alike; other columns
are ignored; an empty table gives an empty result. Ids outside the vocabulary make decoding fail.
"""

import base64
import hashlib
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What a Python worker remembers, some 200 MB at most: entries used twice, and entries used once; for pieces and for pre-tokens.
PIECES, PRE_TOKENS = (450_000, 250_000), (200_000, 150_000)

#: Lower ranks have higher bits, so that the length of a word of the bitmap tells its first set rank.
BIT = [1 << 255 - i for i in range(256)]

def ranks_of(file: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the lines of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.splitlines())}


class Memory:
    """A bounded map of two ages: what is asked for again moves to the lasting part, so that single entries do not push it out."""

    def __init__(self, bounds: tuple[int, int]):
        self.bounds = bounds
        self.lasting: dict = {}
        self.fresh: dict = {}

    def get(self, key):
        x = self.lasting.get(key)
        if x is None and (x := self.fresh.pop(key, None)) is not None:
            if len(self.lasting) >= self.bounds[0]:
                self.lasting.clear()
            self.lasting[key] = x
        return x

    def put(self, key, value) -> None:
        if len(self.fresh) >= self.bounds[1]:
            self.halve(self.fresh)
        self.fresh[key] = value

    @staticmethod
    def halve(held: dict) -> None:
        """Drop the entries that came first."""
        newer = list(islice(held.items(), len(held) // 2, None))
        held.clear()
        held.update(newer)


class Coder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.told = {str(i): t for t, i in ranks.items()}
        self.bytes = [ranks[bytes([b])] for b in range(256)]
        self.words = [0] * (max(ranks.values()) // 256 + 1)  # empty between calls; at most 256 words under one summary
        if len(self.words) > 256:
            raise ValueError("ranks beyond 65535")
        self.pre = Memory(PRE_TOKENS)
        self.pieces = Memory(PIECES)

    def merged(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return (whole,)
        n, words, get, bit = len(piece), self.words, ranks.get, BIT
        token = [self.bytes[b] for b in piece]
        after, before = list(range(1, n + 2)), list(range(-1, n))
        rank_at = [get(piece[i : i + 2]) for i in range(n - 1)]
        rank_at += (None, None)
        buckets: dict[int, int | list[int]] = {}  # a position, or a heap of some
        summary = 0
        for i, r in enumerate(rank_at):
            if r is None:
                continue
            held = buckets.get(r)
            if held is None:
                buckets[r] = i
                w = r >> 8
                words[w] |= bit[r & 255]
                summary |= bit[w]
            elif type(held) is int:
                buckets[r] = [held, i]
            else:
                held.append(i)
        while summary:
            w = 255 - (summary.bit_length() - 1)
            bits = words[w]
            r = (w << 8) + 256 - bits.bit_length()
            held = buckets[r]
            if type(held) is list:
                i = heappop(held)
                if not held:
                    held = None
            else:
                i, held = held, None
            if held is None:
                del buckets[r]
                words[w] = bits = bits ^ bit[r & 255]
                if not bits:
                    summary ^= bit[w]
            if rank_at[i] != r:
                continue
            gone = after[i]
            end = after[gone]
            rank_at[gone] = None
            after[i] = end
            before[end] = i
            token[i] = r
            at = i
            r = get(piece[i : after[end]]) if end < n else None
            while True:  # the pair that the new token begins, then the one that it ends
                rank_at[at] = r
                if r is not None:
                    held = buckets.get(r)
                    if held is None:
                        buckets[r] = at
                        w = r >> 8
                        words[w] |= bit[r & 255]
                        summary |= bit[w]
                    elif type(held) is int:
                        buckets[r] = [held, at] if held < at else [at, held]
                    else:
                        heappush(held, at)
                if at < i or not i:
                    break
                at = before[i]
                r = get(piece[at:end])
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = after[i]
        return tuple(out)

    def plain(self, text: str) -> str:
        """Ids of text, match by match of the pattern, as decimals joined by commas."""
        out = []
        for m in self.split(text):
            ids = self.pre.get(m)
            if ids is None:
                ids = ",".join(map(str, self.merged(m.encode("utf-8", "replace"))))
                if len(m) <= 64:
                    self.pre.put(m, ids)
            out.append(ids)
        return ",".join(out)

    def decimals(self, text: str) -> str:
        """Ids of text as decimals joined by commas, piece by piece from memory."""
        if not text:
            return ""
        pieces = text.split(" ")
        out = list(map(self.pieces.lasting.get, pieces))
        out[0] = self.plain(pieces[0])
        if not pieces[0] or pieces[0][-1].isspace() and len(pieces) > 1:
            return ",".join([self.plain(x) for x in self.joined(pieces)])
        if None in out:
            if any(not p or p[0].isspace() or p[-1].isspace() for p, x in zip(pieces, out, strict=True) if x is None):
                return ",".join([self.plain(x) for x in self.joined(pieces)])
            for i, x in enumerate(out):
                if x is None:
                    out[i] = self.piece(pieces[i])
        return ",".join(out)

    def piece(self, p: str) -> str:
        """Ids of a piece with the space before it."""
        x = self.pieces.get(p)
        if x is None:
            x = self.plain(" " + p)
            if len(p) <= 64:
                self.pieces.put(p, x)
        return x

    @staticmethod
    def joined(pieces: list[str]) -> list[str]:
        """The text again, cut only at spaces between two characters that are not white space."""
        out = [pieces[0]]
        for last, p in zip(pieces, pieces[1:], strict=False):
            if last and p and not last[-1].isspace() and not p[0].isspace():
                out.append(" " + p)
            else:
                out[-1] += " " + p
        return out

    def encode(self, text: str) -> list[int]:
        return list(map(int, self.decimals(text).split(","))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(file: bytes, pattern: str) -> Coder:
    """The coder of a rank file; one in each Python worker."""
    return common.kept("bpe", (file, pattern), lambda: Coder(ranks_of(file), pattern))


def _sent(spark, path: str):
    """The rank file is of fixed size, under a megabyte, and goes to every executor."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, ids array<int>)."""
    file = _sent(docs.sparkSession, path)

    def run(batches):
        own = coder(file.value, pattern)
        for batch in batches:
            ids = [own.encode(t) for t in common.texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    rows = docs.select(id_col, text)
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """(id_col, bytes binary), from the columns id_col and ids; null ids count as none."""
    file = _sent(encoded.sparkSession, path)

    def run(batches):
        own = coder(file.value, pattern)
        for batch in batches:
            data = [own.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=[id_col, "bytes"])

    rows = encoded.select(id_col, "ids")
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, bytes binary")


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text: id_col, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded bytes); ids too if asked for."""
    file = _sent(docs.sparkSession, path)

    def run(batches):
        own = coder(file.value, pattern)
        for batch in batches:
            texts = common.texts_of(batch.column(1))
            for lo, hi in common.by_bytes(np.array([len(t) for t in texts]), 2_000_000):
                counts, of_ids, of_bytes, all_ids = [], [], [], []
                for t in texts[lo:hi]:
                    decimals = own.decimals(t)
                    ids = decimals.split(",") if decimals else []
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(decimals.encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(b"".join(map(own.told.__getitem__, ids))).hexdigest())
                    if with_ids:
                        all_ids.append(np.array(ids, np.int32))
                columns = [batch.column(0).slice(lo, hi - lo), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(all_ids, pa.list_(pa.int32()))] * with_ids, names=names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    rows = docs.select(id_col, text)
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def tokenizer() -> tuple[str, str]:
    """The rank file and the pattern of the query and the stage."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark, sf_dir: str) -> DataFrame:
    return digests(common.table(spark, sf_dir, "documents"), *tokenizer())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised corpus: ids of every document, and the digests of ids and of the decoded bytes."""
    return digests(docs, *tokenizer(), with_ids=True)
