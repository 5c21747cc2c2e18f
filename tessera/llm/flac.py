"""Operator 5: media columns stored as FLAC.

Bytes become signed 8-bit samples of one channel and are stored as a FLAC stream: STREAMINFO with the MD5 of the samples, a
seek table with one point per frame, then frames of BLOCK samples, each a constant, a fixed-predictor (order 0 to 2) or a
quantised linear-predictor subframe with Rice-coded residuals, a CRC-8 of its header and a CRC-16 of the frame. Reading
checks both sums and the MD5. Frames of many rows are coded together: numpy works on all samples of a group at once, and
the unary codes of a group's frames are followed in step. Reading gives PCM blocks, each with its sample offset in the stream, and
a place in the stream is found by its block's offset. The query passes the stored streams as rows from the step that stores to the one that reads.

Defined results: null and empty texts are stored as 64 zero bytes. Equal texts give equal values. Repeated rows are stored
each. An empty table gives an empty result. A damaged frame, sum or MD5 raises ValueError.
"""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

BLOCK = 4096  #: samples of a frame
RATE = 8000
ORDER = 4  #: of the linear predictor
PRECISION = 8  #: bits of its quantised coefficients
GROUP = 4_000_000  #: samples read together, whose frames are followed in step
PART = 500_000  #: samples written together, so that arrays of them stay in the processor's cache
ROWS = 64  #: codes of each frame that are unpacked together, for the same reason


def _crc_table(poly: int, bits: int, n: int) -> np.ndarray:
    """[distance, byte]: what a byte that far before the end adds to the sum; sums are linear, so they are XORs of these."""
    top, mask = 1 << bits - 1, (1 << bits) - 1
    base = np.zeros(256, np.uint32)
    for b in range(256):
        c = b << bits - 8
        for _ in range(8):
            c = (c << 1 ^ poly if c & top else c << 1) & mask
        base[b] = c
    out = np.zeros((n, 256), np.uint32)
    out[0] = base
    for d in range(1, n):
        out[d] = (out[d - 1] << 8 & mask) ^ base[out[d - 1] >> bits - 8]
    return out.astype(np.uint16)


_tables: dict[int, np.ndarray] = {}


def _table(bits: int, n: int) -> np.ndarray:
    if bits not in _tables or len(_tables[bits]) < n:
        _tables[bits] = _crc_table(0x07 if bits == 8 else 0x8005, bits, max(n, 16 if bits == 8 else 6000))
    return _tables[bits]


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int) -> np.ndarray:
    """CRC of data[start:end] for each pair; spans follow one another and are not empty."""
    sizes = ends - starts
    first = (np.cumsum(sizes) - sizes).astype(np.int32)
    n = int(sizes.sum())
    step = np.arange(n, dtype=np.int32)
    at = step + np.repeat((starts - first).astype(np.int32), sizes)
    back = np.repeat((ends - 1).astype(np.int32), sizes)
    back -= at
    back <<= 8
    back |= data[at]
    return np.bitwise_xor.reduceat(_table(bits, int(sizes.max())).ravel().take(back), first)


def utf8_number(n: int) -> bytes:
    """A frame's number in the extended UTF-8 of frame headers."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << 5 * k + 1)
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 1)][::-1]
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *tail])


def ramp(sizes: np.ndarray) -> np.ndarray:
    """0 .. size - 1 for each size, one after another."""
    out = np.arange(int(sizes.sum()), dtype=np.int32)
    out -= np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    return out


def packed(n: int, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """n bytes with each value, of 16 bits at most, in the bits up to its last one. No two share a bit, so those that end in one byte are joined by their sum."""
    held = np.bincount(last >> 3, values << 7 - (last & 7), n).astype(np.int32)
    out = held & 255
    out[:-1] |= held[1:] >> 8 & 255
    out[:-2] |= held[2:] >> 16
    return out.astype(np.uint8)


def predictors(before: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients [frame, ORDER] of linear prediction, and each frame's shift (0: none fits). before: ORDER zeros and all samples."""
    auto = np.empty((ORDER + 1, len(sizes)))
    for lag in range(ORDER + 1):
        products = before[ORDER:] * before[ORDER - lag : len(before) - lag]
        for j in range(lag):
            products[starts[sizes > j] + j] = 0
        auto[lag] = np.add.reduceat(products, starts, dtype=np.int32)  # 4,096 products of 14 bits
    a, err = np.zeros((ORDER + 1, len(sizes))), auto[0] + 1e-9
    for m in range(1, ORDER + 1):
        k = (auto[m] - sum(a[i] * auto[m - i] for i in range(1, m))) / err
        a[1:m], a[m] = a[1:m] - k * a[1:m][::-1].copy(), k
        err = np.maximum(err * (1 - k * k), 1e-9)
    most = np.abs(a[1:]).max(0)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(most, 1e-6) * 1.01)), 0, 14).astype(np.int64)
    limit = (1 << PRECISION - 1) - 1
    q = np.clip(np.rint(a[1:].T * (1 << shift)[:, None]), -limit - 1, limit).astype(np.int64)
    return q, np.where((most > 1e-4) & (most < 60), shift, 0)


def frames_of(x: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Each frame's bytes. x: the samples of all frames; sizes: samples of each; numbers: of each in its stream."""
    n, starts = len(sizes), np.cumsum(sizes) - sizes
    before = np.concatenate([np.zeros(ORDER, np.int32), x])
    wide, one, two = (before[ORDER - j : len(before) - j] for j in range(3))
    coefs, shift = predictors(before, starts, sizes)
    guess = sum(np.repeat(coefs[:, j].astype(np.int32), sizes) * before[ORDER - 1 - j : len(before) - 1 - j] for j in range(ORDER)) >> np.repeat(shift.astype(np.int32), sizes)
    residuals = [wide.copy(), wide - one, wide - 2 * one + two, wide - guess]
    orders = np.array([0, 1, 2, ORDER])
    # what each predictor would take, by its mean residual; the linear one also stores coefficients
    for o, r in zip(orders, residuals, strict=True):
        for j in range(o):
            r[starts[sizes > j] + j] = 0
    cost = np.array([np.add.reduceat(np.abs(r), starts, dtype=np.int32) for r in residuals]).astype(np.float64)
    cost = np.log2(cost / np.maximum(sizes - orders[:, None], 1) + 1) * sizes + 8 * orders[:, None] + np.array([0, 0, 0, 9 + PRECISION * ORDER])[:, None]
    cost[3, (shift == 0) | (sizes <= 2 * ORDER)] = np.inf
    kind = cost.argmin(0)
    order = orders[kind]
    still = np.maximum.reduceat(x, starts) == np.minimum.reduceat(x, starts)
    r = residuals[3]
    for i in np.unique(kind[kind < 3]):
        np.copyto(r, residuals[i], where=np.repeat(kind == i, sizes))
    if still.any():
        r[np.repeat(still, sizes)] = 0
    u = r << 1 ^ r >> 31
    mean = np.add.reduceat(u, starts, dtype=np.int32) / np.maximum(sizes - order, 1)
    k = np.clip(np.floor(np.log2(np.maximum(mean * 0.7, 1))), 0, 14).astype(np.int32)
    k_of = np.repeat(k, sizes)
    width = (u >> k_of) + k_of + 1
    bare = np.concatenate([np.flatnonzero(np.repeat(still, sizes)) if still.any() else starts[:0], *[starts[(order > j) & (sizes > j)] + j for j in range(ORDER)]])  # samples without a code
    width[bare] = 0
    head = [b"\xff\xf8\x70\x02" + utf8_number(int(i)) + int(s - 1).to_bytes(2, "big") for i, s in zip(numbers, sizes, strict=True)]
    head_bytes = np.array([len(h) + 1 for h in head])
    linear = kind == 3
    extra = np.where(still, 8, 8 * order + np.where(linear, 9 + PRECISION * ORDER, 0) + 10)
    body = np.add.reduceat(width, starts)
    total = head_bytes + -(-(8 + extra + body) // 8) + 2
    at = np.cumsum(total) - total
    sub = (at + head_bytes) * 8
    after, lin = sub + 8 + 8 * order, linear & ~still
    fields = [(sub + 7, np.where(still, 0, np.where(linear, 32 | ORDER - 1, 8 | order)) << 1), (sub[still] + 15, wide[starts[still]] & 255)]
    for j in range(ORDER):
        has = ~still & (order > j)
        fields.append((sub[has] + 15 + 8 * j, wide[starts[has] + j] & 255))
    fields += [(after[lin] + 3, np.full(lin.sum(), PRECISION - 1)), (after[lin] + 8, shift[lin])]
    fields += [(after[lin] + 8 + PRECISION * (j + 1), coefs[lin, j] & (1 << PRECISION) - 1) for j in range(ORDER)]
    after = after + np.where(linear, 9 + PRECISION * ORDER, 0)
    fields.append((after[~still] + 9, k[~still]))  # Rice codes with 4-bit parameters, one partition: zeros, then k
    ends = np.cumsum(width, dtype=np.int32)
    last = ends + np.repeat((after + 9 - ends[starts] + width[starts]).astype(np.int32), sizes)
    stop = np.repeat(1 << k, sizes)  # the one that ends the unary part
    code = u & stop - 1 | stop
    code[bare] = 0
    fields.append((last, code))
    out = packed(int(total.sum()), *(np.concatenate(f).astype(np.int32) for f in zip(*fields, strict=True)))
    joined = np.frombuffer(b"".join(h + b"\0" for h in head), np.uint8)
    spots = np.repeat(at, head_bytes) + ramp(head_bytes)
    out[spots] = joined
    out[at + head_bytes - 1] = checksums(out, at, at + head_bytes - 1, 8)
    end = at + total
    sums = checksums(out, at, end - 2, 16)
    out[end - 2], out[end - 1] = sums >> 8, sums & 255
    data = out.tobytes()
    return [data[a:b] for a, b in zip(at.tolist(), end.tolist(), strict=True)]


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload's bytes; no payload is empty."""
    spans = [(p, f, min(BLOCK, len(d) - f * BLOCK)) for p, d in enumerate(payloads) for f in range(-(-len(d) // BLOCK))]
    frames: list[list[bytes]] = [[] for _ in payloads]
    for lo, hi in common.by_bytes(np.array([s[2] for s in spans]), PART):
        part = spans[lo:hi]
        x = np.frombuffer(b"".join(payloads[p][f * BLOCK : f * BLOCK + s] for p, f, s in part), np.uint8)
        coded = frames_of((x ^ 128).view(np.int8), np.array([s[2] for s in part]), np.array([s[1] for s in part]))
        for (p, _, _), b in zip(part, coded, strict=True):
            frames[p].append(b)
    out = []
    for d, fs in zip(payloads, frames, strict=True):
        sizes = [len(f) for f in fs]
        md5 = hashlib.md5((np.frombuffer(d, np.uint8) ^ 128).tobytes()).digest()
        fixed = (RATE << 44 | 0 << 41 | 7 << 36 | len(d)).to_bytes(8, "big")
        info = BLOCK.to_bytes(2, "big") * 2 + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + fixed + md5
        at, points = 0, []
        for i, n in enumerate(sizes):
            points.append((i * BLOCK).to_bytes(8, "big") + at.to_bytes(8, "big") + min(BLOCK, len(d) - i * BLOCK).to_bytes(2, "big"))
            at += n
        out.append(b"".join([b"fLaC", b"\x00", len(info).to_bytes(3, "big"), info, b"\x83", (18 * len(points)).to_bytes(3, "big"), *points, *fs]))
    return out


def opened(stream: bytes) -> tuple[int, bytes, list[tuple[int, int, int]], int]:
    """Of a stream: samples, MD5, seek points (first sample, offset, samples), where frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, samples, md5, points = 4, False, 0, b"", []
    while not last:
        last, kind, n = bool(stream[at] & 128), stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            samples, md5 = packed & (1 << 36) - 1, block[18:34]
            if packed >> 36 & 31 != 7 or packed >> 41 & 7:
                raise ValueError("only one channel of 8 bits is read")
        elif kind == 3:
            points = [(int.from_bytes(block[i : i + 8], "big"), int.from_bytes(block[i + 8 : i + 16], "big"), int.from_bytes(block[i + 16 : i + 18], "big")) for i in range(0, n, 18)]
        at += 4 + n
    return samples, md5, points, at


def words_of(data: np.ndarray) -> np.ndarray:
    """The 24 bits from each byte on; zeros follow the last one."""
    room = np.concatenate([data, np.zeros(3, np.uint8)]).astype(np.int32)
    return room[:-2] << 16 | room[1:-1] << 8 | room[2:]


def field(words: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The unsigned numbers of width bits, 17 at most, at these places."""
    return (words[at >> 3] >> 24 - width - (at & 7) & (1 << width) - 1).astype(np.int64)


def signed(x: np.ndarray, width: int) -> np.ndarray:
    return x - ((x >> width - 1) << width)


def samples_of(frames: list[bytes]) -> list[np.ndarray]:
    """The samples of each frame, after its sums are verified."""
    sizes_b = np.array([len(f) for f in frames])
    data = np.frombuffer(b"".join(frames), np.uint8)
    start = np.cumsum(sizes_b) - sizes_b
    end = start + sizes_b
    number = data[start + 4]
    digits = np.where(number < 0x80, 1, 7 - np.floor(np.log2(np.maximum(255 - number, 1))).astype(int))
    head = start + 4 + digits + 2
    sizes = (data[head - 2].astype(np.int64) << 8 | data[head - 1]) + 1
    ok = (data[start] == 0xFF) & (data[start + 1] == 0xF8) & (data[start + 2] == 0x70) & (data[start + 3] == 0x02) & (end - head >= 5)
    if not ok.all() or (checksums(data, start, head, 8) != data[head]).any():
        raise ValueError("a frame's header is damaged")
    if (checksums(data, start, end - 2, 16) != (data[end - 2].astype(np.uint32) << 8 | data[end - 1])).any():
        raise ValueError("a frame is damaged")
    words = words_of(data)
    sub = (head + 1) * 8
    kind = field(words, sub, 8) >> 1
    still, linear = kind == 0, kind >= 32
    order = np.where(linear, (kind & 31) + 1, np.where(kind >= 8, kind & 7, 0))
    n, most = len(frames), int(order.max(initial=0))
    out: list[np.ndarray] = [np.empty(0, np.int8)] * n
    for f in np.flatnonzero(still):
        out[f] = np.full(sizes[f], data[head[f] + 2]).view(np.int8)
    first = np.zeros((n, max(most, 1)), np.int64)
    for j in range(most):
        has = order > j
        first[has, j] = signed(field(words, sub[has] + 8 + 8 * j, 8), 8)
    after = sub + 8 + 8 * order
    coefs, shift = np.zeros((n, max(most, 1)), np.int64), np.zeros(n, np.int64)
    lin = np.flatnonzero(linear)
    if len(lin):
        precision = field(words, after[lin], 4) + 1
        shift[lin] = field(words, after[lin] + 4, 5)
        for p in np.unique(precision):
            own = lin[precision == p]
            for j in range(most):
                has = own[order[own] > j]
                coefs[has, j] = signed(field(words, after[has] + 9 + p * j, int(p)), int(p))
            after[own] += 9 + p * order[own]
    live = np.flatnonzero(~still)
    if len(live):
        if field(words, after[live], 6).any():
            raise ValueError("only one partition with 4-bit Rice parameters is read")
        turn = np.argsort(order[live] - sizes[live], kind="stable")
        own = live[turn]
        count = (sizes - order)[own]
        r = residuals_of(data, words, (after + 10)[own].astype(np.int32), field(words, (after + 6)[own], 4).astype(np.int32), count, (end[own] - 2) * 8)
        for key in np.unique(kind[own]):
            at = np.flatnonzero(kind[own] == key)
            has, o = own[at], int(order[own[at[0]]])
            x = np.concatenate([first[has, :o].T.astype(np.int32), r[: count[at[0]]].take(at, axis=1)])
            if linear[has[0]]:
                c, s = coefs[has, :o].T[::-1].astype(np.int32).copy(), shift[has].astype(np.int32)
                for lo, hi, m in steps(count[at]):
                    c, s, y = c[:, :m], s[:m], x[:, :m]
                    for t in range(lo + o, hi + o):
                        y[t] += np.einsum("ij,ij->j", c, y[t - o : t]) >> s
            elif o:
                fixed(x, o)
            for f, row in zip(has, np.ascontiguousarray(x.astype(np.int8).T), strict=True):
                out[f] = row[: sizes[f]]
    return out


def steps(count: np.ndarray):
    """(lo, hi, m) by which the numbers of falling counts are walked: from lo to hi, the first m have more."""
    lo = 0
    for hi in np.unique(count).tolist():
        yield lo, hi, int(np.searchsorted(-count, -hi, side="right"))
        lo = hi


_lanes: list[np.ndarray] = []


def zeros_from(data: np.ndarray) -> np.ndarray:
    """For each bit, how many zeros stand from there to the next one. Read off a table of 16 bits, which has eight places in a number; longer runs by the next byte that is not 0."""
    if not _lanes:
        v = np.arange(1 << 16)
        ahead = [np.where(x, 16 - np.frexp(x)[1], 255) for x in (v << b & 0xFFFF for b in range(8))]
        _lanes.append(np.stack(ahead, axis=1).astype(np.uint8).view(np.uint64).ravel())
    pairs = data.astype(np.int64) << 8
    pairs[:-1] |= data[1:]
    out = _lanes[0].take(pairs).view(np.uint8)
    far = np.flatnonzero(out == 255)
    if len(far):
        full = np.append(np.flatnonzero(data != 0), len(data))
        at = full[np.searchsorted(full, np.minimum((far >> 3) + 2, len(data)))]
        zeros = at * 8 + 8 - np.frexp(np.append(data, 255)[at].astype(np.float32))[1] - far
        out = out.astype(np.min_scalar_type(zeros.max()))
        out[far] = zeros
    return out


def residuals_of(data: np.ndarray, words: np.ndarray, at: np.ndarray, k: np.ndarray, count: np.ndarray, end: np.ndarray) -> np.ndarray:
    """[code, frame]: Rice codes of each frame from its place on, falling in count; they end before the frame's sum. All frames step to their next code together."""
    out, zeros, now = np.zeros((int(count.max(initial=0)), len(at)), np.int32), zeros_from(data), at.astype(np.int64)
    step = k + 1
    for lo, hi, m in steps(count):
        a, over = now[:m], step[:m]
        for stop in out[lo:hi, :m]:
            np.add(a, zeros.take(a, mode="clip"), out=stop, casting="same_kind")
            np.add(stop, over, out=a)
    if (now > end).any():
        raise ValueError("a frame's codes go beyond it")
    before, ones = at - step, (1 << k) - 1
    for lo in range(0, len(out), ROWS):
        stop = out[lo : lo + ROWS]
        u = np.diff(stop, axis=0, prepend=before[None]) - step
        before = stop[-1].copy()
        stop += 1
        low = words.take(stop >> 3, mode="clip")
        low >>= 24 - (stop & 7) - k
        low &= ones
        u <<= k
        u |= low
        np.bitwise_xor(u >> 1, -(u & 1), out=stop)
    return out


def fixed(x: np.ndarray, order: int) -> None:
    """Undo the differences of a fixed predictor in [sample, frame]; the first `order` rows are samples."""
    lead = [x[:order].copy()]
    for _ in range(order - 1):
        lead.append(np.diff(lead[-1], axis=0))
    for j in range(order):  # the highest difference first: each sum begins with the last known value of its level
        r = x[order - 1 :]
        r[0] = lead[order - 1 - j][-1]
        np.cumsum(r, axis=0, out=r)
    x[:order] = lead[0]


def pcm_blocks(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """(sample offset, payload bytes) of every frame of each stream; both sums of each frame and the MD5 are verified."""
    pieces, parts, heads = [], [[] for _ in streams], []
    for i, s in enumerate(streams):
        samples, md5, points, at = opened(s)
        ends = [p[1] for p in points[1:]] + [len(s) - at]
        pieces += [(i, s[at + p[1] : at + e], p[2], p[0]) for p, e in zip(points, ends, strict=True)]
        heads.append((samples, md5))
    for lo, hi in common.by_bytes(np.array([p[2] for p in pieces]), GROUP):
        for (i, _, n, offset), x in zip(pieces[lo:hi], samples_of([p[1] for p in pieces[lo:hi]]), strict=True):
            if len(x) != n or offset != (parts[i][-1][0] + len(parts[i][-1][1]) if parts[i] else 0):
                raise ValueError("a frame is not where the seek table says")
            parts[i].append((offset, x))
    out = []
    for (samples, md5), xs in zip(heads, parts, strict=True):
        x = np.concatenate([x for _, x in xs])
        if len(x) != samples or hashlib.md5(x.tobytes()).digest() != md5:
            raise ValueError("the samples do not have the stream's MD5")
        out.append([(offset, (x.view(np.uint8) ^ 128).tobytes()) for offset, x in xs])
    return out


def decode(streams: list[bytes]) -> list[bytes]:
    """The payload bytes of each stream."""
    return [b"".join(x for _, x in blocks) for blocks in pcm_blocks(streams)]


def tail(blocks: list[tuple[int, bytes]], n: int) -> bytes:
    """The last n bytes, from the blocks whose offsets say that they hold them."""
    end = blocks[-1][0] + len(blocks[-1][1])
    return b"".join(x for offset, x in blocks if offset + len(x) > end - n)[-n:]


def read_from(stream: bytes, sample: int, count: int) -> bytes:
    """Bytes of `count` samples from `sample` on: only the frames that hold them are read."""
    samples, _, points, at = opened(stream)
    hit = [i for i, p in enumerate(points) if p[0] < min(sample + count, samples) and p[0] + p[2] > sample]
    if not hit:
        return b""
    ends = [p[1] for p in points[1:]] + [len(stream) - at]
    x = np.concatenate(samples_of([stream[at + points[i][1] : at + ends[i]] for i in hit]))
    first = sample - points[hit[0]][0]
    return (x[first : first + count].view(np.uint8) ^ 128).tobytes()


def payload(text: str | None) -> bytes:
    """UTF-8 bytes of text, and zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "replace")
    return data + bytes(-len(data) % 64 or (0 if data else 64))


def feature(x: np.ndarray, n: int) -> str:
    """Mean, mean absolute step and share of sign changes of the samples, and zeros of padding."""
    y = (x ^ 128).view(np.int8).astype(np.int16)
    below = y < 0
    step, flips = np.abs(np.diff(y)).sum(), np.count_nonzero(below[1:] != below[:-1])
    return f"mean={y.mean():.4f};step={step / max(1, len(y) - 1):.4f};flips={flips / max(1, len(y) - 1):.4f};pad={len(y) - n}"


def store(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each text as a FLAC stream."""
    def run(batches):
        for batch in batches:
            data = [payload(t) for t in batch.column(1).to_pylist()]
            sizes = [len((t or "").encode("utf-8", "replace")) for t in batch.column(1).to_pylist()]
            for lo, hi in common.by_bytes(np.array([len(d) for d in data]), 8 * GROUP):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(sizes[lo:hi], pa.int64()), pa.array(encode(data[lo:hi]), pa.binary())], names=[id_col, "n_bytes", "media"])

    rows = docs.select(id_col, text)
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def blocks(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, sample_offset, pcm): the samples of every frame, each with its place in the stream; none where media is null."""
    def run(batches):
        for batch in batches:
            for i, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if m is not None:
                    at, pcm = zip(*pcm_blocks([m])[0], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * len(at), batch.schema[0].type), pa.array(at, pa.int64()), pa.array(pcm, pa.binary())], names=[id_col, "sample_offset", "pcm"])

    rows = stored.select(id_col, "media")
    return common.arrow(rows, run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, sample_offset long, pcm binary")


def features(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Reads what store() gives (media not null) and tells: n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_frames."""
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches):
        for batch in batches:
            sizes, media = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for lo, hi in common.by_bytes(np.array(sizes, np.int64), 2 * GROUP):
                rows = []
                for n, m, pcm in zip(sizes[lo:hi], media[lo:hi], pcm_blocks(media[lo:hi]), strict=True):
                    x = b"".join(b for _, b in pcm)
                    rows.append((n, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(tail(pcm, 64)), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(x, np.uint8), n), len(pcm)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    rows = stored.select(id_col, "n_bytes", "media")
    spark_kinds = {"int64": "long", "string": "string"}
    return common.arrow(rows, run, ", ".join([f"`{id_col}` {rows.schema[0].dataType.simpleString()}"] + [f"{n} {spark_kinds[str(k)]}" for n, k in zip(names[1:], kinds, strict=True)]))


def query(spark, sf_dir: str) -> DataFrame:
    return features(store(common.table(spark, sf_dir, "documents")))
