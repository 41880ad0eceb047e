"""Media columns as FLAC: a lossless writer and a reader of Rice residuals and linear predictors.

The reader finds frames by their sync code, checks the header's CRC-8, the frame numbers' order and the
CRC-16 of each frame, decodes the residuals of all frames of a batch in step (numpy works on one sample of
every frame at a time), undoes the fixed or linear predictor and returns PCM blocks, each with the sample offset
at which it begins.  The writer makes mono streams of 8-bit samples with fixed predictors of order 0 to 2,
Rice-coded residuals (verbatim frames where these are no shorter), checksums, an MD5 of the samples and a
seek table.

The reader takes mono streams of 4 to 24 bits a sample with constant, verbatim, fixed and LPC subframes,
both Rice methods, partitions and escapes.  A damaged or unsupported stream is a ``FlacError``; in columns it
gives a row that says so.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_dir, slices, tune

BLOCK = 1024
#: A seek point every so many frames.
SEEK_EVERY = 16
RATE = 8000
PAD = 64
MAX_FRAME = 1 << 17
#: Frames that are coded or decoded together.
TOGETHER = 1024


class FlacError(ValueError):
    pass


# ---------------------------------------------------------------- checksums


def _table(poly: int, width: int) -> np.ndarray:
    top, mask = 1 << (width - 1), (1 << width) - 1
    out = []
    for b in range(256):
        v = b << (width - 8)
        for _ in range(8):
            v = (v << 1 ^ poly) & mask if v & top else v << 1 & mask
        out.append(v)
    return np.array(out, np.uint16)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)
_by_place: list[np.ndarray] = []


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(CRC8[c ^ b])
    return c


def crc16_many(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each buf[start:end] (not empty).  The sum is linear: each byte adds what its distance from the end makes of it."""
    longest = int((ends - starts).max())
    if longest > 4096:  # rare: in steps of single bytes
        return np.array([_crc16(buf[a:b]) for a, b in zip(starts, ends, strict=True)], np.uint16)
    while len(_by_place) < longest:
        last = _by_place[-1] if _by_place else None
        _by_place.append(CRC16.copy() if last is None else (last << 8) ^ CRC16[last >> 8])
    table = np.stack(_by_place[: max(longest, 1)]).ravel() if not hasattr(crc16_many, "flat") or crc16_many.flat.size < longest * 256 else crc16_many.flat
    crc16_many.flat = table
    sizes = ends - starts
    firsts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    at = np.arange(int(sizes.sum())) - np.repeat(firsts, sizes)
    place = np.repeat(sizes, sizes) - 1 - at
    data = buf[at + np.repeat(starts, sizes)]
    return np.bitwise_xor.reduceat(table[place * 256 + data], firsts)


def _crc16(data: np.ndarray) -> int:
    c = 0
    for b in data.tolist():
        c = (c << 8 & 0xFFFF) ^ int(CRC16[c >> 8 ^ b])
    return c


# ---------------------------------------------------------------- writer


def coded_number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        if n < limit:
            lead = (0xFF << (7 - len(tail)) & 0xFF) | n
            return bytes([lead, *reversed(tail)])
        limit >>= 1


_headers: dict[tuple[int, int], bytes] = {}


def frame_header(number: int, samples: int) -> bytes:
    key = (number, samples)
    if key not in _headers:
        if len(_headers) > 50_000:
            _headers.clear()
        full = samples == BLOCK
        h = bytes([0xFF, 0xF8, 0xA0 if full else 0x70, 0x02]) + coded_number(number) + (b"" if full else struct.pack(">H", samples - 1))
        _headers[key] = h + bytes([crc8(h)])
    return _headers[key]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload (none empty); byte b is the sample b - 128.

    Frames are made ``TOGETHER`` at a time, so what is held besides the streams doesn't grow with a payload.
    """
    if not all(payloads):
        raise ValueError("a stream has one sample at least")
    made: list[list[tuple[bytes, np.ndarray, np.ndarray]]] = [[] for _ in payloads]
    group: list[tuple[int, int, bytes]] = []  # stream, number of its first frame, samples
    held = 0

    def close() -> None:
        nonlocal group, held
        if group:
            for (s, _, _), found in zip(group, _encode_frames([g[1] for g in group], [g[2] for g in group]), strict=True):
                made[s].append(found)
        group, held = [], 0

    for s, p in enumerate(payloads):
        for at in range(0, len(p), TOGETHER * BLOCK):
            part = p[at : at + TOGETHER * BLOCK]
            if held + len(part) > TOGETHER * BLOCK:
                close()
            group.append((s, at // BLOCK, part))
            held += len(part)
    close()
    streams = []
    for p, parts in zip(payloads, made, strict=True):
        total, length = np.concatenate([x[1] for x in parts]), np.concatenate([x[2] for x in parts])
        at = np.cumsum(total) - total
        points = b"".join(struct.pack(">QQH", i * BLOCK, int(at[i]), int(length[i])) for i in range(0, len(total), SEEK_EVERY))
        signed = (np.frombuffer(p, np.uint8) ^ np.uint8(128)).tobytes()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(total.min()).to_bytes(3, "big") + int(total.max()).to_bytes(3, "big") + (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        streams.append(b"".join([b"fLaC\x00", (34).to_bytes(3, "big"), info, b"\x83", len(points).to_bytes(3, "big"), points, *(x[0] for x in parts)]))
    return streams


def _encode_frames(firsts: list[int], payloads: list[bytes]) -> list[tuple[bytes, np.ndarray, np.ndarray]]:
    """For each run of samples its frames, numbered from ``firsts``: their bytes, sizes and samples."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    x = raw.astype(np.int32) - 128
    frames = -(-sizes // BLOCK)
    inner = np.arange(int(frames.sum())) - np.repeat(np.cumsum(frames) - frames, frames)
    number = inner + np.repeat(np.array(firsts, np.int64), frames)
    begin = np.repeat(np.cumsum(sizes) - sizes, frames) + inner * BLOCK
    length = np.minimum(BLOCK, np.repeat(np.cumsum(sizes), frames) - begin)
    inside = np.arange(len(x)) - np.repeat(begin, length)

    diffs = [x]
    for _ in range(2):
        d = diffs[-1].copy()
        d[1:] -= diffs[-1][:-1]
        diffs.append(d)
    size = np.stack([np.add.reduceat(np.where(inside >= p, np.abs(d), 0), begin) for p, d in enumerate(diffs)])
    order = size.argmin(0)
    order[length <= 4] = 0
    per = np.repeat(order, length)
    r = np.choose(per, diffs)
    u = np.where(r >= 0, 2 * r, -2 * r - 1)
    mean = np.add.reduceat(np.where(inside >= per, u, 0), begin) / np.maximum(1, length - order)
    k0 = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))), 0, 13).astype(np.int64)
    bits = []
    for k in (k0, k0 + 1):
        kk = np.repeat(k, length)
        bits.append(np.add.reduceat(np.where(inside >= per, (u >> kk) + 1 + kk, 8), begin))
    better = bits[1] < bits[0]
    k = np.where(better, k0 + 1, k0)
    coded = np.where(better, bits[1], bits[0]) + 10
    verbatim = coded >= 8 * length
    body = 8 + np.where(verbatim, 8 * length, coded)

    headers = [frame_header(int(n), int(s)) for n, s in zip(number, length, strict=True)]
    head = np.array([len(h) for h in headers], np.int64)
    total = head + -(-body // 8) + 2
    at = np.cumsum(total) - total  # in bytes
    out = np.zeros(int(total.sum()) * 8, np.uint8)  # a byte for each bit

    flat = np.frombuffer(b"".join(headers), np.uint8)
    spot = np.arange(len(flat)) - np.repeat(np.cumsum(head) - head, head) + np.repeat(at, head)
    packed_heads = (spot, flat)

    sub = (at + head) * 8  # first bit of the subframe
    kind = np.where(verbatim, 0b00000010, (0b001000 | order) << 1)
    for j in range(8):
        out[sub + j] = kind >> (7 - j) & 1
    # coding method 0, one partition, its parameter after the warm-up samples
    c = np.nonzero(~verbatim)[0]
    param = sub[c] + 8 + 8 * order[c] + 6
    for j in range(4):
        out[param + j] = k[c] >> (3 - j) & 1

    plain = np.repeat(verbatim, length) | (inside < per)
    kk = np.repeat(k, length)
    q = np.where(plain, 0, u >> kk)
    width = np.where(plain, 8, kk)
    value = np.where(plain, x & 0xFF, u & ((1 << kk) - 1))
    cost = np.where(plain, 8, q + 1 + kk)
    run = np.cumsum(cost) - cost
    first = np.repeat(run[begin], length)
    extra = np.where(np.repeat(verbatim, length) | (inside < per), 0, 10)
    start = np.repeat(sub + 8, length) + run - first + extra
    stops = ~plain
    out[(start + q)[stops]] = 1
    here = start + np.where(plain, 0, q + 1)
    for j in range(int(width.max())):
        m = width > j
        out[here[m] + j] = value[m] >> (width[m] - 1 - j) & 1
    data = np.packbits(out)
    data[packed_heads[0]] = packed_heads[1]
    ends = at + total
    sums = crc16_many(data, at, ends - 2)
    data[ends - 2], data[ends - 1] = sums >> 8, sums & 0xFF

    out_, f = [], 0
    whole = data.tobytes()
    for n in frames.tolist():
        out_.append((whole[int(at[f]) : int(ends[f + n - 1])], total[f : f + n], length[f : f + n]))
        f += n
    return out_


# ---------------------------------------------------------------- reader


@dataclass
class Stream:
    """What the metadata says, and where the frames begin."""

    bits: int
    samples: int
    rate: int
    block: int
    md5: bytes
    frames_at: int
    seek: list[tuple[int, int, int]]


def read_metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC" or len(data) < 42:
        raise FlacError("no FLAC stream")
    at, last, info, seek = 4, False, None, []
    while not last:
        if at + 4 > len(data):
            raise FlacError("the metadata is cut off")
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("the metadata is cut off")
        if kind == 0:
            if len(body) != 34:
                raise FlacError("the stream info is cut off")
            packed = int.from_bytes(body[10:18], "big")
            if packed >> 41 & 7:
                raise FlacError("only mono is read")
            info = (int((packed >> 36 & 31) + 1), packed & (1 << 36) - 1, packed >> 44, struct.unpack(">H", body[2:4])[0], body[18:34])
        elif kind == 3:
            seek = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size - 17, 18)]
        at += 4 + size
    if info is None:
        raise FlacError("there is no stream info")
    return Stream(*info, at, seek)


def read_number(data: bytes, at: int) -> tuple[int, int]:
    """(number, place after it); -1 where it is none."""
    b = data[at] if at < len(data) else 0xFF
    if b < 0x80:
        return b, at + 1
    n = 0
    while b << n & 0x80:
        n += 1
    if n < 2 or n > 7 or at + n > len(data):
        return -1, at
    v = b & (0x7F >> n)
    for c in data[at + 1 : at + n]:
        if c & 0xC0 != 0x80:
            return -1, at
        v = v << 6 | c & 0x3F
    return v, at + n


def read_header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """(frame number, samples, place of the subframe) of a frame header whose CRC-8 is right."""
    if at + 6 > len(data) or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 1:
        return None
    size, rate = data[at + 2] >> 4, data[at + 2] & 15
    if not size or rate == 15:
        return None
    number, p = read_number(data, at + 4)
    if number < 0:
        return None
    if size == 6:
        samples, p = data[p] + 1 if p < len(data) else 0, p + 1
    elif size == 7:
        samples, p = int.from_bytes(data[p : p + 2], "big") + 1, p + 2
    else:
        samples = 192 if size == 1 else 576 << (size - 2) if size < 6 else 256 << (size - 8)
    p += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        return None
    return number, samples, p + 1


def find_frames(streams: list[bytes], metas: list[Stream]) -> tuple[np.ndarray, np.ndarray]:
    """Frames of all streams in their joined bytes: rows (stream, begin, subframe, end, samples, sample offset).

    Between two headers that follow each other by number lies one frame if its CRC-16 is right; a header
    that only looks like one fails there and is passed over.
    """
    joined = np.frombuffer(b"".join(streams), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    syncs = np.nonzero((joined[:-1] == 0xFF) & ((joined[1:] & 0xFE) == 0xF8))[0]
    owner = np.searchsorted(base, syncs, "right") - 1
    candidates: list[list[tuple[int, int, int, int]]] = [[] for _ in streams]
    for s, at in zip(owner.tolist(), (syncs - base[owner]).tolist(), strict=True):
        if at >= metas[s].frames_at and (h := read_header(streams[s], at)):
            candidates[s].append((at, *h))
    rows, unsure = [], []
    for s, found in enumerate(candidates):
        chain = []
        for c in found:
            if c[1] == len(chain):
                chain.append(c)
        sure = len(chain) == len(found)
        ends = [c[0] for c in chain[1:]] + [len(streams[s])]
        offset = 0
        for c, end in zip(chain, ends, strict=True):
            rows.append((s, base[s] + c[0], base[s] + c[3], base[s] + end, c[2], offset))
            offset += c[2]
        if not sure:
            unsure.append(s)
    table = np.array(rows, np.int64).reshape(-1, 6)
    good = np.zeros(len(table), bool)
    if len(table):
        fits = table[:, 3] - table[:, 1] > 4
        sums = crc16_many(joined, table[fits, 1], table[fits, 3] - 2)
        good[fits] = sums == (joined[table[fits, 3] - 2].astype(np.uint16) << 8 | joined[table[fits, 3] - 1])
    redo = sorted({int(s) for s in table[~good, 0]} & set(unsure))
    if redo:
        again = []
        for s in redo:
            again += _chain(streams[s], candidates[s], s, int(base[s]))
        keep = ~np.isin(table[:, 0], redo)
        more = np.array(again, np.int64).reshape(-1, 7)
        table = np.concatenate((table[keep], more[:, :6]))
        good = np.concatenate((good[keep], more[:, 6].astype(bool)))
        by = np.lexsort((table[:, 1], table[:, 0]))
        table, good = table[by], good[by]
    return table, good


def _chain(data: bytes, found: list[tuple[int, int, int, int]], s: int, base: int) -> list[tuple[int, ...]]:
    """The frames of one stream in which some headers only look like ones: the first end with a right CRC-16 counts."""
    buf = np.frombuffer(data, np.uint8)
    rows, offset, i, number = [], 0, 0, 0
    while i < len(found):
        at, n, samples, sub = found[i]
        if n != number:
            i += 1
            continue
        ends = [(j, found[j][0]) for j in range(i + 1, len(found)) if found[j][1] == number + 1] + [(len(found), len(data))]
        for j, end in ends:
            if end - at > 4 and _crc16(buf[at : end - 2]) == int(buf[end - 2]) << 8 | int(buf[end - 1]):
                rows.append((s, base + at, base + sub, base + end, samples, offset, 1))
                break
        else:
            j, end = ends[0]
            rows.append((s, base + at, base + sub, base + end, samples, offset, 0))
        offset += samples
        number += 1
        i = j
    return rows


class _Bits:
    """Reads bits at many places of one buffer at a time."""

    def __init__(self, buf: np.ndarray):
        padded = np.concatenate((buf, np.zeros(8, np.uint8))).astype(np.uint32)
        self.window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
        bits = np.unpackbits(buf)
        n = len(bits)
        place = np.where(bits, np.arange(n, dtype=np.int32), np.int32(n))
        self.next_one = np.append(np.minimum.accumulate(place[::-1])[::-1], np.int32([n] * 64))
        self.end = n

    def read(self, pos: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 24 bits."""
        w = self.window[np.minimum(pos >> 3, len(self.window) - 1)].astype(np.int64)
        return w >> (32 - (pos & 7) - width) & ((1 << np.asarray(width, np.int64)) - 1)

    def signed(self, pos: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        v = self.read(pos, width)
        return v - ((v >> (np.asarray(width) - 1) & 1) << np.asarray(width, np.int64))


def decode_frames(joined: np.ndarray, sub: np.ndarray, samples: np.ndarray, bps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each frame (rows, padded with 0) and whether it could be decoded."""
    b = _Bits(joined)
    lanes, most = len(sub), int(samples.max()) if len(samples) else 0
    out = np.zeros((most, lanes), np.int64)  # a sample of all frames lies together
    ok = np.ones(lanes, bool)
    pos = sub.astype(np.int64) * 8
    kind = b.read(pos + 1, 6)
    wasted_flag = b.read(pos + 7, 1).astype(bool)
    pos = pos + 8
    wasted = np.zeros(lanes, np.int64)
    if wasted_flag.any():
        one = b.next_one[np.minimum(pos, b.end)].astype(np.int64)
        wasted = np.where(wasted_flag, one - pos + 1, 0)
        pos = np.where(wasted_flag, one + 1, pos)
    width = bps - wasted
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    ok &= ((kind < 2) | fixed | lpc) & (width > 0)
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    order = np.where(ok, order, 0)

    for lane in np.nonzero(ok & (kind == 0))[0]:
        out[: samples[lane], lane] = b.signed(pos[lane : lane + 1], width[lane : lane + 1])[0]
    v = np.nonzero(ok & (kind == 1))[0]
    if len(v):
        for i in range(int(samples[v].max())):
            m = v[samples[v] > i]
            out[i, m] = b.signed(pos[m] + i * width[m], width[m])
    coded = np.nonzero(ok & (order >= 0) & (fixed | lpc))[0]
    ok[coded[order[coded] > samples[coded]]] = False
    coded = coded[ok[coded]]
    if not len(coded):
        return out, ok
    for i in range(int(order[coded].max())):
        m = coded[order[coded] > i]
        out[i, m] = b.signed(pos[m], width[m])
        pos[m] += width[m]
    coefs = np.zeros((32, lanes), np.int64)
    shift = np.zeros(lanes, np.int64)
    m = coded[lpc[coded]]
    if len(m):
        precision = b.read(pos[m], 4) + 1
        ok[m[precision == 16]] = False
        shift[m] = b.signed(pos[m] + 4, 5)
        ok[m[shift[m] < 0]] = False
        pos[m] += 9
        for i in range(int(order[m].max())):
            has = order[m] > i
            coefs[i, m[has]] = b.signed(pos[m[has]], precision[has])
            pos[m[has]] += precision[has]
    method = b.read(pos[coded], 2)
    ok[coded[method > 1]] = False
    partitions = b.read(pos[coded] + 2, 4)
    pos[coded] += 6
    keep = ok[coded]
    coded, method, partitions = coded[keep], method[keep], partitions[keep]
    per = samples[coded] >> partitions
    # the next sample of each frame at which a partition begins
    boundary = order[coded].copy()
    p = pos[coded]
    k = np.zeros(len(coded), np.int64)
    escape = np.full(len(coded), -1, np.int64)
    count = samples[coded]
    own_order = order[coded]
    part_end = per.copy()
    size = np.where(method == 1, 5, 4)
    alive = np.ones(len(coded), bool)
    one_partition = not partitions.any()
    window, next_one = b.window, b.next_one
    for i in range(int(own_order.min()) if len(coded) else 0, int(count.max()) if len(coded) else 0):
        heads = (boundary == i) & alive & (i < count)
        if heads.any():
            h = np.nonzero(heads)[0]
            k[h] = b.read(p[h], size[h])
            p[h] += size[h]
            esc = k[h] == (1 << size[h]) - 1
            escape[h] = -1
            if esc.any():
                e = h[esc]
                escape[e] = b.read(p[e], 5)
                p[e] += 5
            boundary[h] = np.where(part_end[h] < count[h], part_end[h], 1 << 40)
            part_end[h] += per[h]
            again = (boundary[h] == i) & (i < count[h])  # an empty first partition
            while again.any():
                h = h[again]
                k[h] = b.read(p[h], size[h])
                p[h] += size[h]
                boundary[h] = np.where(part_end[h] < count[h], part_end[h], 1 << 40)
                part_end[h] += per[h]
                again = (boundary[h] == i) & (i < count[h])
            plain_rice = not (escape >= 0).any()
            uniform = plain_rice and one_partition and bool((own_order <= i).all())
        active = None if uniform and i < int(count.min()) and alive.all() else np.nonzero(alive & (own_order <= i) & (i < count))[0]
        if active is not None and not len(active):
            continue
        pp = p if active is None else p[active]
        kk = k if active is None else k[active]
        one = next_one[pp].astype(np.int64)
        q = one - pp
        after = one + 1
        w = window[np.minimum(after >> 3, len(window) - 1)].astype(np.int64)
        u = q << kk | (w >> (32 - (after & 7) - kk)) & ((1 << kk) - 1)
        r = (u >> 1) ^ -(u & 1)
        new = after + kk
        if not plain_rice:
            esc = escape if active is None else escape[active]
            e = np.nonzero(esc >= 0)[0]
            r[e] = np.where(esc[e] > 0, b.signed(pp[e], np.maximum(esc[e], 1)), 0)
            new[e] = pp[e] + esc[e]
        if active is None:
            out[i, coded], p = r, new
        else:
            out[i, coded[active]] = r
            p[active] = new
        over = new > b.end
        if over.any():
            bad = np.nonzero(over)[0] if active is None else active[over]
            alive[bad] = False
            p[bad] = 0
            ok[coded[bad]] = False
    # undo the predictors
    for n in np.unique(order[coded[fixed[coded]]]):
        lanes_n = coded[fixed[coded] & (order[coded] == n)]
        a = out[:, lanes_n]
        initial = [a[0]] if n else []
        level = a[: int(n)]
        for _ in range(1, int(n)):
            level = level[1:] - level[:-1]
            initial.append(level[0])
        for lev in range(int(n), 0, -1):
            a[lev - 1] = initial[lev - 1]
            a[lev - 1 :] = np.cumsum(a[lev - 1 :], axis=0)
        out[:, lanes_n] = a
    for n in np.unique(order[coded[lpc[coded]]]):
        lanes_n = coded[lpc[coded] & (order[coded] == n)]
        a, c, s = out[:, lanes_n], coefs[: int(n), lanes_n], shift[lanes_n]
        for i in range(int(n), most):
            a[i] += (c * a[i - int(n) : i][::-1]).sum(0) >> s
        out[:, lanes_n] = a
    if wasted.any():
        out <<= wasted
    return out, ok


@dataclass
class Block:
    """A PCM block of a stream: its number, the sample at which it begins, and the samples (None: damaged)."""

    number: int
    sample_offset: int
    n_samples: int
    samples: np.ndarray | None


def decode_many(streams: list[bytes]) -> list[tuple[Stream, list[Block]] | FlacError]:
    """For each stream its metadata and blocks, or why it can't be read."""
    out: list = [None] * len(streams)
    metas, which = [], []
    for i, s in enumerate(streams):
        try:
            metas.append(read_metadata(s))
            which.append(i)
        except FlacError as e:
            out[i] = e
    data = [streams[i] for i in which]
    if not data:
        return out
    frames, good = find_frames(data, metas)
    for j, i in enumerate(which):
        out[i] = (metas[j], [])
    if not len(frames):
        return out
    joined = np.frombuffer(b"".join(data), np.uint8)
    bps = np.array([m.bits for m in metas], np.int64)[frames[:, 0]]
    live = np.nonzero(good)[0]
    counts = [0] * len(data)
    decoded: dict[int, np.ndarray] = {}
    for k in range(0, len(live), TOGETHER):
        lanes = live[k : k + TOGETHER]
        low, high = int(frames[lanes, 1].min()), int(frames[lanes, 3].max())
        samples, ok = decode_frames(joined[low:high], frames[lanes, 2] - low, frames[lanes, 4], bps[lanes])
        rows = samples.T
        for c, f in enumerate(lanes.tolist()):
            if ok[c]:
                decoded[f] = rows[c, : int(frames[f, 4])].astype(np.int32)
    for f in range(len(frames)):
        s, n = int(frames[f, 0]), int(frames[f, 4])
        out[which[s]][1].append(Block(counts[s], int(frames[f, 5]), n, decoded.get(f)))
        counts[s] += 1
    return out


def seek(data: bytes, sample: int) -> np.ndarray:
    """The samples from ``sample`` to the end of its block, reading from the seek point before it."""
    meta = read_metadata(data)
    if not 0 <= sample < meta.samples:
        raise FlacError("there is no such sample")
    point = max((p for p in meta.seek if p[0] <= sample), default=(0, 0, 0))
    at, first = meta.frames_at + point[1], point[0]
    found = []
    p = at
    while (p := data.find(b"\xff", p)) >= 0:
        if h := read_header(data, p):
            found.append((p, *h))
        p += 1
    base = found[0][1] if found else 0
    rows = _chain(data, [(a, n - base, s, sub) for a, n, s, sub in found], 0, 0)
    for _, _, sub, _, n, offset, right in rows:
        if first + offset <= sample < first + offset + n:
            if not right:
                raise FlacError("the frame is damaged")
            out, ok = decode_frames(np.frombuffer(data, np.uint8), np.array([sub]), np.array([n]), np.array([meta.bits]))
            if not ok[0]:
                raise FlacError("the frame can't be decoded")
            return out[sample - first - offset : n, 0]
    raise FlacError("there is no such sample")


# ---------------------------------------------------------------- columns


def padded(text: str | None) -> tuple[bytes, int]:
    """The text as UTF-8, zeros up to a positive multiple of 64, and its own length."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b"\0" * (max(PAD, -(-len(raw) // PAD) * PAD) - len(raw)), len(raw)


def features(samples: np.ndarray) -> str:
    """Peak, mean, root mean square and zero crossings of the samples, from whole-number sums."""
    n = len(samples)
    x = samples.astype(np.int64)
    crossings = int(((x[1:] >= 0) != (x[:-1] >= 0)).sum())
    return f"n={n};peak={int(np.abs(x).max())};mean={int(x.sum()) / n:.4f};rms={(int((x * x).sum()) / n) ** 0.5:.4f};crossings={crossings}"


def store(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes (unpadded) and media, the padded text as a FLAC stream.

    Null and empty texts are 64 zeros; a null id stays null; texts of any length are stored whole; repeated rows give
    repeated rows, equal texts equal streams; other columns are ignored, whatever their names; an empty table gives none.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 1_000_000):
            both = [padded(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for _, n in both], pa.int64()), pa.array(encode_many([p for p, _ in both]), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


MEDIA = "doc_id long, n_bytes long, media binary"


def write_media(docs: DataFrame, folder: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``store``'s rows written below ``folder`` (a URI all executors reach), and that table as it reads from there.

    Samples of text hardly get shorter in FLAC, but the file's own compression sees what repeats in them.
    """
    store(docs, doc_id=doc_id, text=text).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "6").parquet(folder)
    return docs.sparkSession.read.schema(MEDIA).parquet(folder)


def new_folder(df: DataFrame) -> str:
    """A new folder for media in the shared folder."""
    return f"{shared_dir(df.sparkSession).rstrip('/')}/media-{uuid.uuid4().hex}"


def pcm_blocks(media: DataFrame, *, key: str = "doc_id", column: str = "media") -> DataFrame:
    """PCM blocks of a media column: key, block, sample_offset, n_samples, pcm (little-endian, 8 or 32 bits), status.

    status is ``ok``, ``damaged`` (a checksum or code is wrong; pcm is null) or what is wrong with the whole stream
    (one row, block null).  Null media gives no row, nor does an empty table; repeated rows give repeated blocks.
    """
    tune(media.sparkSession)
    kind = media.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "m", 1_000_000):
            cols: list[list] = [[] for _ in range(6)]
            for key_, found in zip(batch.column(0).to_pylist(), decode_many(batch.column(1).to_pylist()), strict=True):
                if isinstance(found, FlacError):
                    rows = [(key_, None, None, None, None, str(found))]
                else:
                    small = found[0].bits <= 8
                    rows = [(key_, b.number, b.sample_offset, b.n_samples, None if b.samples is None else b.samples.astype("<i1" if small else "<i4").tobytes(), "damaged" if b.samples is None else "ok") for b in found[1]]
                for r in rows:
                    for c, v in zip(cols, r, strict=True):
                        c.append(v)
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "block", "sample_offset", "n_samples", "pcm", "status"])

    rows = media.where(F.col(column).isNotNull()).select(F.col(key).alias("key"), F.col(column).alias("m"))
    return rows.mapInArrow(run, f"key {kind.simpleString()}, block int, sample_offset long, n_samples int, pcm binary, status string").withColumnRenamed("key", key)


def digest(media: DataFrame) -> DataFrame:
    """Of ``store``'s rows: what the stored bytes hold when they are read back, and how many PCM blocks they are.

    last_block_offset is the sample at which the last block begins.  A row whose stream can't be read back whole
    fails the job: the store is lossless or nothing.  Repeated rows give repeated rows; an empty table gives none.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pcm_blocks", "last_block_offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media", 1_000_000):
            streams = batch.column(2).to_pylist()
            cols: list[list] = [[] for _ in range(8)]
            for s, found in zip(streams, decode_many(streams), strict=True):
                if isinstance(found, FlacError):
                    raise found
                meta, blocks = found
                if any(b.samples is None for b in blocks):
                    raise FlacError("a stored frame is damaged")
                x = np.concatenate([b.samples for b in blocks])
                if hashlib.md5(x.astype(np.int8).tobytes()).digest() != meta.md5 or len(x) != meta.samples:
                    raise FlacError("the samples' MD5 is wrong")
                payload = (x + 128).astype(np.uint8).tobytes()
                for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(s), hashlib.sha256(s).hexdigest(), features(x), len(blocks), blocks[-1].sample_offset), strict=True):
                    c.append(v)
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long, last_block_offset long")
