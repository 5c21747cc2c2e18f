"""Operator 5: round trips, checks, seeking, the digest columns."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import flac


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=9000), min_size=1, max_size=4))
def test_round_trip(payloads):
    assert flac.decode(flac.encode(payloads)) == payloads


def signals():
    rng = np.random.default_rng(1)
    sine = (128 + 90 * np.sin(np.arange(20_000) / 9) + rng.normal(0, 2, 20_000)).clip(0, 255).astype(np.uint8).tobytes()
    return {"sine": sine, "noise": rng.integers(0, 256, 9000, dtype=np.uint8).tobytes(), "still": b"\x07" * 5000, "steps": bytes([0, 255] * 3000), "ramp": bytes(range(256)) * 20}


@pytest.mark.parametrize("name", list(signals()))
def test_signals(name):
    data = signals()[name]
    media = flac.encode([data])[0]
    assert flac.decode([media]) == [data]
    assert len(media) < len(data) * (0.8 if name != "noise" else 1.1)
    for at, n in ((0, 1), (4095, 2), (len(data) - 3, 9), (4096, 4096), (len(data), 5)):
        assert flac.read_from(media, at, n) == data[at : at + n]


def test_every_predictor_is_used():
    kinds = set()
    for data in signals().values():
        media = flac.encode([data])[0]
        at = flac.opened(media)[3]
        kinds.add(media[at + 8] >> 1)
    assert 0 in kinds and any(k >= 32 for k in kinds) and any(8 <= k <= 10 for k in kinds)


def test_damage_is_found():
    media = flac.encode([signals()["sine"]])[0]
    at = flac.opened(media)[3]
    for i in (at + 1, at + 5, at + 400, len(media) - 1, 30):
        bad = bytearray(media)
        bad[i] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])
    with pytest.raises(ValueError):
        flac.decode([b"RIFF" + media[4:]])


def test_checksums():
    data = np.frombuffer(b"123456789", np.uint8)
    one = lambda bits: int(flac.checksums(data, np.array([0]), np.array([9]), bits)[0])
    assert (one(8), one(16)) == (0xF4, 0xFEE8)  # published check values of both sums
    assert [flac.utf8_number(n).hex() for n in (5, 0x80, 0x800, 0x10000)] == ["05", "c280", "e0a080", "f0908080"]


def test_query(odd, empty):
    got = {}
    for r in flac.features(flac.store(odd)).collect():
        got.setdefault((r.doc_id), []).append(r)
    for r in odd.where("doc_id is not null").collect():
        raw = (r.text or "").encode()
        full = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        x = got[r.doc_id][0]
        assert (x.n_bytes, x.payload_bytes, x.payload_sha256, x.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[1][0][1:] == got[1][1][1:] == got[2][0][1:] and flac.features(flac.store(empty)).count() == 0


def test_blocks(odd):
    rows = flac.blocks(flac.store(odd.where("doc_id = 6"))).orderBy("sample_offset").collect()
    text = odd.where("doc_id = 6").first().text.encode()
    assert b"".join(bytes(r.pcm) for r in rows)[: len(text)] == text and [r.sample_offset for r in rows] == list(range(0, 4096 * len(rows), 4096))


def test_tail_and_seek_table():
    data = bytes(range(256)) * 40
    media = flac.encode([data])[0]
    pcm = flac.pcm_blocks([media])[0]
    assert [at for at, _ in pcm] == [0, 4096, 8192] and all(flac.tail(pcm, n) == data[-n:] for n in (1, 64, 2048, 2049, 6200, len(data)))
    bad = bytearray(media)
    bad[4 + 4 + 34 + 4 + 18 + 7] ^= 1  # the second seek point's sample number
    with pytest.raises(ValueError):
        flac.pcm_blocks([bytes(bad)])


class Bits:
    """Bits of a stream, most significant first."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | (self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1)
            self.at += 1
        return out

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if x >> (n - 1) else x

    def rice(self, k):
        q = 0
        while not self.take(1):
            q += 1
        x = q << k | self.take(k)
        return -(x + 1 >> 1) if x & 1 else x >> 1


def crc(data, poly, bits):
    c = 0
    for byte in data:
        c ^= byte << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c >> bits - 1 else c << 1) & ((1 << bits) - 1)
    return c


def plain_decode(stream):
    """The samples of a mono 8-bit stream, bit by bit, by the format's description; nothing of the module's own."""
    assert stream[:4] == b"fLaC"
    at, last, md5, total = 4, False, None, 0
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
            md5, total = info[18:34], int.from_bytes(info[13:18], "big") & ((1 << 36) - 1)
        at += 4 + size
    samples = []
    while at < len(stream):
        b = Bits(stream[at:])
        assert b.take(14) == 0x3FFE and b.take(1) == 0
        b.take(1)
        size_code, rate_code, channels, width, zero = b.take(4), b.take(4), b.take(4), b.take(3), b.take(1)
        assert channels == 0 and width in (0, 1) and zero == 0
        lead = b.take(8)
        for _ in range(max(0, 7 - (lead ^ 255).bit_length() - 1) if lead >= 0xC0 else 0):
            assert b.take(2) == 2
            b.take(6)
        n = {6: lambda: b.take(8) + 1, 7: lambda: b.take(16) + 1}.get(size_code, lambda: 192 if size_code == 1 else 576 << size_code - 2 if size_code < 6 else 256 << size_code - 8)()
        b.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0))
        assert crc(stream[at : at + b.at // 8], 7, 8) == b.take(8)
        assert b.take(1) == 0
        kind, wasted = b.take(6), b.take(1)
        assert wasted == 0
        if kind == 0:
            x = [b.signed(8)] * n
        elif kind == 1:
            x = [b.signed(8) for _ in range(n)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [b.signed(8) for _ in range(order)]
            if kind >= 32:
                precision, shift = b.take(4) + 1, b.signed(5)
                coefficients = [b.signed(precision) for _ in range(order)]
            else:
                shift, coefficients = 0, [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]][order]
            wide, parts = (4, 5)[b.take(2)], b.take(4)
            for p in range(1 << parts):
                k = b.take(wide)
                raw = b.take(5) if k == (1 << wide) - 1 else None
                for _ in range((n >> parts) - (order if p == 0 else 0)):
                    e = b.rice(k) if raw is None else b.signed(raw) if raw else 0
                    x.append(e + (sum(c * x[-1 - i] for i, c in enumerate(coefficients)) >> shift))
        b.at = -(-b.at // 8) * 8
        assert crc(stream[at : at + b.at // 8], 0x8005, 16) == b.take(16)
        samples += x
        at += b.at // 8
    pcm = np.array(samples, np.int8).tobytes()
    assert len(samples) == total and hashlib.md5(pcm).digest() == md5
    return (np.frombuffer(pcm, np.uint8) ^ 128).tobytes()


def test_against_a_plain_decoder():
    """A decoder of its own reads every kind of stream that is written."""
    data = [x[:9000] for x in signals().values()] + [b"\x00" * 64, "Ünï text of words, one after another. ".encode() * 130]
    for payload, media in zip(data, flac.encode(data), strict=True):
        assert plain_decode(media) == payload


def peak(run) -> int:
    """Bytes that are held at once, at most."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_arrays_stay_small():
    """What is held for a sample while streams are written and read: no array of all bits in wide numbers, and no writing of millions of samples at once."""
    rng = np.random.default_rng(2)
    payloads = [b" ".join(rng.choice([b"stone", b"river", b"green", b"Apple,", b"lighthouse"], 700))[:4096] for _ in range(488)]
    n = sum(map(len, payloads))
    flac.decode(flac.encode(payloads[:1]))
    media = flac.encode(payloads)
    assert peak(lambda: flac.encode(payloads)) < 30 * n
    assert peak(lambda: flac.decode(media)) < 50 * n


def test_long_runs_of_zeros():
    """Rare steps in still signals: unary codes of more than 16, 255 and 4,096 zeros, beside frames without any."""
    rare = [bytes([v if i == at else 0 for i in range(n)]) for v, n, at in ((255, 4096, 4000), (255, 9000, 8999), (90, 70, 3), (128, 4096, 4))]
    mixed = [*rare, *signals().values(), bytes(64), b"a" * 4095 + b"\xff"]
    assert flac.decode(flac.encode(mixed)) == mixed
    data = np.zeros(9000, np.uint8)
    data[[0, 9, 600, 601, 8998]] = 1, 128, 3, 255, 16
    bits, want, run = np.unpackbits(data), np.zeros(72_000, int), 8
    for i in range(71_999, -1, -1):  # no one follows the last: 0xFF is taken to stand behind the data
        run = want[i] = 0 if bits[i] else (run + 1 if i < 71_999 else 1)
    assert (flac.zeros_from(data) == want).all()


def test_codes_beyond_a_frame():
    """A frame whose sums are right but which has fewer codes than its header says."""
    frame = bytearray(flac.frames_of((np.arange(600) * 7 % 90).astype(np.int8), np.array([600]), np.array([0]))[0])
    frame[5:7] = (4095).to_bytes(2, "big")
    one = lambda data, bits: int(flac.checksums(np.frombuffer(bytes(data), np.uint8), np.array([0]), np.array([len(data)]), bits)[0])
    frame[7] = one(frame[:7], 8)
    frame[-2:] = one(frame[:-2], 16).to_bytes(2, "big")
    with pytest.raises(ValueError):
        flac.samples_of([bytes(frame)])
