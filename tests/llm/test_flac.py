import hashlib
import os
import random
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import flac


def samples(found):
    assert not isinstance(found, Exception), found
    return np.concatenate([b.samples for b in found[1]])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=3000), min_size=1, max_size=6))
def test_round_trip(payloads):
    for p, found in zip(payloads, flac.decode_many(flac.encode_many(payloads)), strict=True):
        x = samples(found)
        assert (x + 128).astype(np.uint8).tobytes() == p
        assert hashlib.md5(x.astype(np.int8).tobytes()).digest() == found[0].md5


def test_sync_codes_inside_frames():
    payloads = [b"\xff\xf8\xa0\x02\x01" * 900, b"\xff\xf8" * 2000, os.urandom(70_000), bytes(5000), bytes(i % 256 for i in range(9000))]
    for p, found in zip(payloads, flac.decode_many(flac.encode_many(payloads)), strict=True):
        assert (samples(found) + 128).astype(np.uint8).tobytes() == p


class Writer:
    """A slow writer of any subframe, for the reader's other ways."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> (width - 1 - i) & 1 for i in range(width)]

    def rice(self, r, k):
        u = 2 * r if r >= 0 else -2 * r - 1
        self.bits += [0] * (u >> k) + [1]
        self.put(u & (1 << k) - 1, k)


def stream(frames, bits, block):
    """Frames (samples, subframe bits) of one stream."""
    out, n = b"", 0
    for number, (count, sub) in enumerate(frames):
        head = bytes([0xFF, 0xF8, 0x70, 0x00]) + flac.coded_number(number) + struct.pack(">H", count - 1)
        head += bytes([flac.crc8(head)])
        body = head + np.packbits(sub).tobytes()
        c = flac._crc16(np.frombuffer(body, np.uint8))
        out += body + struct.pack(">H", c)
        n += count
    info = struct.pack(">HH", block, block) + bytes(6) + (8000 << 44 | (bits - 1) << 36 | n).to_bytes(8, "big") + bytes(16)
    return b"fLaC\x80" + (34).to_bytes(3, "big") + info + out


def test_linear_prediction_partitions_escapes_and_wasted_bits():
    r = random.Random(1)
    x = [int(2000 * np.sin(i / 9)) + r.randint(-5, 5) for i in range(64)]
    coef, shift = [7, -3], 2
    w = Writer()
    w.put(0, 1), w.put(32 + 1, 6), w.put(0, 1)  # LPC of order 2
    for v in x[:2]:
        w.put(v & 0xFFFF, 16)
    w.put(4, 4), w.put(shift, 5)
    for c in coef:
        w.put(c & 31, 5)
    residual = [x[i] - ((coef[0] * x[i - 1] + coef[1] * x[i - 2]) >> shift) for i in range(2, 64)]
    w.put(1, 2), w.put(2, 4)  # five-bit parameters, four partitions
    at = 0
    for p in range(4):
        n = 16 - (2 if p == 0 else 0)
        part = residual[at : at + n]
        if p == 2:
            w.put(31, 5), w.put(14, 5)
            for v in part:
                w.put(v & 0x3FFF, 14)
        else:
            w.put(9, 5)
            for v in part:
                w.rice(v, 9)
        at += n
    c = Writer()
    c.put(0, 1), c.put(0, 6), c.put(1, 1), c.put(0b001, 3), c.put(-5 & 0x1FFF, 13)  # constant, three wasted bits
    f = Writer()
    f.put(0, 1), f.put(8 + 4, 6), f.put(0, 1)  # fixed of order 4
    for v in x[:4]:
        f.put(v & 0xFFFF, 16)
    f.put(0, 2), f.put(0, 4), f.put(8, 4)
    for i in range(4, 64):
        f.rice(x[i] - 4 * x[i - 1] + 6 * x[i - 2] - 4 * x[i - 3] + x[i - 4], 8)
    v = Writer()
    v.put(0, 1), v.put(1, 6), v.put(0, 1)
    for y in x[:20]:
        v.put(y & 0xFFFF, 16)
    data = stream([(64, w.bits), (64, c.bits), (64, f.bits), (20, v.bits)], 16, 64)
    assert samples(flac.decode_many([data])[0]).tolist() == x + [-40] * 64 + x + x[:20]


def test_damage_is_found():
    good = flac.encode_many([os.urandom(2000) * 5])[0]
    bad = bytearray(good)
    bad[len(bad) // 2] ^= 8
    meta, blocks = flac.decode_many([bytes(bad)])[0]
    assert 1 <= sum(b.samples is None for b in blocks) <= 2 and len(blocks) == -(-meta.samples // flac.BLOCK)
    assert [type(x) for x in flac.decode_many([b"", b"RIFF", good[:60]])] == [flac.FlacError] * 3
    with pytest.raises(ValueError):
        flac.encode_many([b""])


def test_seek():
    p = bytes(random.Random(2).randrange(90, 120) for _ in range(40_000))
    data = flac.encode_many([p])[0]
    for at in (0, 1, 1023, 1024, 16_384, 20_000, 39_999):
        got = (flac.seek(data, at) + 128).astype(np.uint8).tobytes()
        assert got == p[at : (at // flac.BLOCK + 1) * flac.BLOCK]
    with pytest.raises(flac.FlacError):
        flac.seek(data, 40_000)


def test_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65_535, 65_536, 2**21, 2**26, 2**31 - 1):
        assert flac.read_number(flac.coded_number(n), 0) == (n, len(flac.coded_number(n)))


def test_columns(spark, messy, none):
    media = flac.store(messy)
    got = {r.doc_id: r for r in flac.digest(media).collect()}
    assert got[2].n_bytes == 0 and got[2].payload_bytes == 64 and got[2].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    assert got[2][2:] == got[3][2:] and got[6].media_sha256 == got[7].media_sha256 and got[6].feature == got[7].feature
    assert got[8].n_bytes == len("ünï çødé 😀 <|endoftext|>".encode())
    assert flac.digest(flac.store(none)).count() == 0
    blocks = flac.pcm_blocks(media.where("doc_id = 6")).orderBy("block").collect()
    assert [b.sample_offset for b in blocks] == [1024 * i for i in range(len(blocks))]
    text = messy.where("doc_id = 6").first().text
    assert bytes((np.frombuffer(b"".join(b.pcm for b in blocks), np.int8).astype(int) + 128).astype(np.uint8)) == flac.padded(text)[0]
    odd = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.status) for r in flac.pcm_blocks(odd).collect()] == [(1, "no FLAC stream")]


def slow_decode(data):
    """The samples of a mono stream of constant, verbatim and fixed subframes, read bit by bit, without the library's reader."""
    at = 4
    while True:
        last, size = data[at] & 0x80, int.from_bytes(data[at + 1 : at + 4], "big")
        if data[at] & 0x7F == 0:
            packed = int.from_bytes(data[at + 14 : at + 22], "big")
            width, total = (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
        at += 4 + size
        if last:
            break
    bits, out = "".join(f"{b:08b}" for b in data), []
    pos = at * 8

    def take(n):
        nonlocal pos
        pos += n
        return int(bits[pos - n : pos], 2) if n else 0

    def signed(n):
        v = take(n)
        return v - (1 << n) if v >> n - 1 else v

    while len(out) < total:
        assert take(15) == 0b111111111111100 and take(1) == 0
        block, _, _ = take(4), take(4), take(8)
        lead = take(8)
        while lead & 0x80 and lead & 0x40:
            take(8)
            lead = lead << 1 & 0xFF
        n = {6: lambda: take(8) + 1, 7: lambda: take(16) + 1}.get(block, lambda: 256 << block - 8)()
        take(8)
        assert take(1) == 0
        kind = take(6)
        assert take(1) == 0
        if kind == 0:
            found = [signed(width)] * n
        elif kind == 1:
            found = [signed(width) for _ in range(n)]
        else:
            order = kind - 8
            found = [signed(width) for _ in range(order)]
            assert take(2) == 0 and take(4) == 0
            k = take(4)
            for _ in range(n - order):
                q = 0
                while not take(1):
                    q += 1
                u = q << k | take(k)
                r = -(u + 1 >> 1) if u & 1 else u >> 1
                found.append(r + [0, found[-1] if order else 0, 2 * found[-1] - found[-2] if order == 2 else 0][order])
        out += found
        pos = -(-pos // 8) * 8 + 16
    return out


def test_an_independent_reader_gives_the_same_samples():
    r = random.Random(6)
    for p in (b"a", bytes(64), b"some text that is padded".ljust(64, b"\0"), os.urandom(1500), bytes(r.choice(b"etaoin shrdlu") for _ in range(5000)), bytes(i // 9 % 256 for i in range(3000))):
        assert slow_decode(flac.encode_many([p])[0]) == [b - 128 for b in p]


def test_long_payloads_in_parts(monkeypatch):
    """A payload gives the same stream whatever is coded together with it, and one of megabytes needs bounded memory."""
    import tracemalloc

    r = random.Random(7)
    payloads = [bytes(r.choice(b"etaoin shrdlu\xff\xf8") for _ in range(n)) for n in (10, 5000, 1024, 9000, 1)]
    whole = flac.encode_many(payloads)
    monkeypatch.setattr(flac, "TOGETHER", 2)
    assert flac.encode_many(payloads) == whole
    for p, found in zip(payloads, flac.decode_many(whole), strict=True):
        assert (samples(found) + 128).astype(np.uint8).tobytes() == p
        assert [b.sample_offset for b in found[1]] == list(range(0, len(p), flac.BLOCK))
    monkeypatch.undo()
    long = (b"some words of a long text, and more of them " * 100_000)[: 4 << 20]
    tracemalloc.start()
    coded = flac.encode_many([long])
    assert tracemalloc.get_traced_memory()[1] < 300e6
    assert (samples(flac.decode_many(coded)[0]) + 128).astype(np.uint8).tobytes() == long
    tracemalloc.stop()


def test_media_is_written_and_read_back(spark, messy, none, tmp_path):
    media = flac.write_media(messy, f"file://{tmp_path}/media")
    assert os.listdir(tmp_path / "media") and media.count() == messy.count()
    got = {r.doc_id: r for r in flac.digest(media).collect()}
    blocks = {}
    for b in flac.pcm_blocks(media.where("doc_id = 6")).collect():
        blocks[b.block] = b
    assert got[6].pcm_blocks == len(blocks) and got[6].last_block_offset == max(b.sample_offset for b in blocks.values())
    assert flac.digest(flac.write_media(none, f"file://{tmp_path}/none")).count() == 0
