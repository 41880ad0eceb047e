"""Substring dedup by super-k-mer partitioning.

Words are runs of anything but ASCII white space; a window is 20 consecutive words of one document.  A word
goes if a window over it has the same word sequence as one that starts earlier (smaller doc_id, or the same
document and an earlier start).

1. The minimiser of a window is the smallest hash of its 3-word groups.  Consecutive windows with the same
   minimiser form a super-k-mer and travel as one packed string (their words, joined by blanks) to the
   minimiser's bucket.  Equal windows have equal minimisers, so they meet there.  What a task has for a bucket
   travels as compressed parcels; the number of buckets follows from the size of the corpus.
2. A task forwards each packed string, and each whole text, only the first time and again where a smaller
   position turns up; all other occurrences are already known to be repeats.  A group of copies reaches its
   bucket with a row or so from each task, whatever its size.
3. A bucket sorts its super-k-mers by minimiser and position.  The windows of a group are looked up in order,
   so the first is the one that stays; the text itself is compared, not a hash of it.
4. A bucket that outgrows ``BUCKET_LIMIT`` stops to hold its largest groups, half of what it has: their windows are dealt out once
   more, each by its own hash, and looked up in a second pass, row by row.
5. The removed spans go back to their documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved, slices, tidy, tune

WINDOW = 20
GROUP = 3
#: Bytes of packed strings in a bucket, about, and those at which it gives up its largest groups.
BUCKET_BYTES = 8 << 20
BUCKET_LIMIT = 128 << 20
#: Bytes of packed strings that a task of the buckets reads, about, however large the corpus.
TASK_BYTES = 64 << 20
#: Bytes of packed strings that a task collects before it sends parcels.
PARCEL_BYTES = 24 << 20
#: Strings, texts and words that a task remembers; forgetting some only sends more rows.
REMEMBERED = 60_000

WORD = re.compile("[^\x20\x09-\x0d]+")
_PARCEL, _SPAN, _WINDOW = 0, 1, 2
_NAMES = ["kind", "key", "d", "t", "first", "last", "data"]
_SCHEMA = "kind int, key long, d long, t long, first int, last int, data binary"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


class WordHashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 5 * REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def group_hashes(h: np.ndarray, group: int = GROUP) -> np.ndarray:
    """A mixed 64-bit hash of each run of ``group`` words."""
    n = len(h) - group + 1
    g = h[:n].copy()
    for j in range(1, group):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : n + j]
    g ^= g >> np.uint64(32)
    g *= np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(29)
    return g


def sliding_min(g: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of ``width`` numbers."""
    m, have = g, 1
    while have * 2 <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    return np.minimum(m[: len(g) - width + 1], m[width - have :]) if have < width else m


def super_kmers(h: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int = WINDOW, group: int = GROUP) -> tuple[np.ndarray, ...]:
    """Super-k-mers of documents that lie one after the other in ``h``: each from ``begin``, ``size`` words, a window at least.

    (document, first word in h, windows, minimiser, whether its minimiser occurs more than once in it)
    """
    wide = window - group + 1
    g = group_hashes(h, group)
    m = sliding_min(g, wide)
    count = size - window + 1
    owner = np.repeat(np.arange(len(begin)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    value = m[at]
    new = np.ones(len(at), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    starts = np.nonzero(new)[0]
    windows = np.diff(np.append(starts, len(at)))
    first, least = at[starts], value[starts]
    groups = windows + wide - 1
    flat = np.arange(int(groups.sum())) - np.repeat(np.cumsum(groups) - groups, groups) + np.repeat(first, groups)
    same = np.add.reduceat((g[flat] == np.repeat(least, groups)).astype(np.int32), np.cumsum(groups) - groups)
    return owner[starts], first, windows, least.view(np.int64), same > 1


def batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


class Parcels:
    """Super-k-mers on their way to buckets: (key, d, t, first, repeats, packed)."""

    def __init__(self, buckets: int):
        self.buckets, self.rows, self.bytes = buckets, [], 0
        self.squeeze = zstd.ZstdCompressor(level=3)

    def add(self, row: tuple) -> None:
        self.rows.append(row)
        self.bytes += len(row[5])

    def send(self) -> Iterator[tuple]:
        if not self.rows:
            return
        key, d, t, first, repeats, packed = zip(*self.rows, strict=True)
        key = np.array(key, np.int64)
        unsigned = key.view(np.uint64)
        bucket = (unsigned % np.uint64(self.buckets)).astype(np.int64)
        # inside a bucket 32 bits of the minimiser group well enough, as texts are compared anyway
        short = (unsigned // np.uint64(self.buckets)).astype(np.uint32)
        numbers = [short, np.array(d, np.int64), np.array(t, np.int32), np.array(first, np.int32), np.array(repeats, np.uint8), np.array([len(x) for x in packed], np.int32)]
        order = np.argsort(bucket, kind="stable")
        cuts = np.nonzero(np.diff(bucket[order]))[0] + 1
        for rows in np.split(order, cuts):
            head = np.array([len(rows)], np.int64).tobytes()
            part = [x[rows] for x in numbers]
            part[1][1:] -= part[1][:-1].copy()  # ids mostly rise: their differences are short
            body = b"".join([head, *(x.tobytes() for x in part), *(packed[i] for i in rows.tolist())])
            yield (_PARCEL, int(bucket[rows[0]]), 0, 0, 0, 0, self.squeeze.compress(body))
        self.rows, self.bytes = [], 0


def unpack(data: bytes) -> tuple[list[np.ndarray], bytes]:
    """The numbers (key, d, t, first, repeats, begin, end of the string) and the strings of a parcel."""
    body = zstd.ZstdDecompressor().decompress(data)
    n, at, out = int(np.frombuffer(body, np.int64, 1)[0]), 8, []
    for kind in (np.uint32, np.int64, np.int32, np.int32, np.uint8, np.int32):
        out.append(np.frombuffer(body, kind, n, at))
        at += out[-1].nbytes
    ends = np.cumsum(out.pop().astype(np.int64))
    out[1] = np.cumsum(out[1])
    return [*out, np.concatenate(([0], ends[:-1])), ends], body[at:]


def split(batches: Iterator[pa.RecordBatch], buckets: int, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Documents (d, t, text) to parcels of super-k-mers and spans already known to be repeats."""
    hashes = WordHashes()
    texts: dict[bytes, tuple[int, int]] = {}
    strings: dict[bytes, tuple[int, int, int]] = {}
    parcels = Parcels(buckets)
    for part in slices(batches, "text", 2_000_000):
        out: list[tuple] = []
        words: list[str] = []
        begin, size, who = [], [], []
        for d, t, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
            w = WORD.findall(text or "")
            if len(w) < window:
                continue
            digest = hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()
            known = texts.get(digest)
            if known is not None and known < (d, t):
                out.append((_SPAN, t % buckets, d, t, 0, len(w), None))
                continue
            if known == (d, t):
                continue
            if len(texts) >= REMEMBERED:
                texts.clear()
            texts[digest] = (d, t)
            begin.append(len(words))
            size.append(len(w))
            who.append((d, t))
            words += w
        if words:
            h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
            b = np.array(begin)
            for doc, first, windows, key, repeats in zip(*(c.tolist() for c in super_kmers(h, b, np.array(size), window)), strict=True):
                d, t = who[doc]
                packed = " ".join(words[first : first + windows + window - 1]).encode("utf-8", "surrogatepass")
                place = (d, t, first - begin[doc])
                known = strings.get(packed)
                if known is not None and known < place:
                    out.append((_SPAN, t % buckets, d, t, place[2], place[2] + windows + window - 1, None))
                    continue
                if len(strings) >= REMEMBERED:
                    strings.clear()
                strings[packed] = place
                parcels.add((key, *place, repeats, packed))
        if parcels.bytes >= PARCEL_BYTES:
            out += parcels.send()
        for i in range(0, len(out), 20_000):
            yield batch(out[i : i + 20_000])
    yield batch(list(parcels.send()))


def windows_of(packed: bytes, window: int) -> Iterator[bytes]:
    """The windows of a packed string, each as the text of its words."""
    ends = [i for i, c in enumerate(packed) if c == 32]
    ends.append(len(packed))
    begin = 0
    for i in range(window - 1, len(ends)):
        yield packed[begin : ends[i]]
        begin = ends[i - window + 1] + 1


class Bucket:
    """The super-k-mers of one bucket, as they come in."""

    def __init__(self, window: int, limit: int):
        self.window, self.limit = window, limit
        self.parts: list[tuple[list[np.ndarray], bytes]] = []
        self.bytes = 0
        self.given_up: set[int] = set()

    def add(self, data: bytes) -> Iterator[tuple]:
        """Take a parcel; the windows of groups that are given up come out."""
        self.parts.append(unpack(data))
        self.bytes += len(self.parts[-1][1])
        if self.given_up:
            part = self.parts.pop()
            self.bytes -= len(part[1])
            yield from self._leave(part)
        while self.bytes > self.limit:
            keys, n = np.unique(np.concatenate([p[0][0] for p in self.parts]), return_counts=True)
            by = np.argsort(-n, kind="stable")
            half = int(np.searchsorted(np.cumsum(n[by]), n.sum() / 2)) + 1
            self.given_up.update(keys[by[:half]].tolist())
            parts, self.parts, self.bytes = self.parts, [], 0
            for p in parts:
                yield from self._leave(p)

    def _leave(self, part: tuple[list[np.ndarray], bytes]) -> Iterator[tuple]:
        """Hold what is still held of a part, and let the rest out as windows."""
        numbers, text = part
        out = np.isin(numbers[0], list(self.given_up))
        for i in np.nonzero(out)[0].tolist():
            d, t, first = (int(numbers[k][i]) for k in (1, 2, 3))
            for j, w in enumerate(windows_of(text[numbers[5][i] : numbers[6][i]], self.window)):
                yield (_WINDOW, xxhash.xxh64_intdigest(w) - (1 << 63), d, t, first + j, 1, w)
        if not out.all():
            keep = ~out
            pieces = [text[a:b] for a, b in zip(numbers[5][keep].tolist(), numbers[6][keep].tolist(), strict=True)]
            ends = np.cumsum([len(p) for p in pieces])
            kept = [x[keep] for x in numbers[:5]] + [np.concatenate(([0], ends[:-1])), ends]
            self.parts.append((kept, b"".join(pieces)))
            self.bytes += int(ends[-1])

    def spans(self) -> Iterator[tuple]:
        """Look the windows up, group by group in the order of their positions."""
        if not self.parts:
            return
        key, d, t, first, repeats = (np.concatenate([p[0][k] for p in self.parts]) for k in range(5))
        part = np.repeat(np.arange(len(self.parts)), [len(p[0][0]) for p in self.parts])
        begin, end = (np.concatenate([p[0][k] for p in self.parts]) for k in (5, 6))
        order = np.lexsort((first, t, d, key))
        same = key[order][1:] == key[order][:-1]
        more = np.concatenate((same, [False])) | np.concatenate(([False], same)) | repeats[order].astype(bool)
        seen: set[bytes] = set()
        now = last = None
        for i in order[more].tolist():
            if key[i] != now:
                now, last, seen = key[i], None, set()
            place = (int(d[i]), int(t[i]), int(first[i]))
            if place == last:  # the same row of a table that holds it twice
                continue
            last = place
            a = b = -1
            for j, w in enumerate(windows_of(self.parts[part[i]][1][begin[i] : end[i]], self.window)):
                if w not in seen:
                    seen.add(w)
                    continue
                if j > b:
                    if b >= 0:
                        yield (_SPAN, 0, *place[:2], place[2] + a, place[2] + b, None)
                    a = j
                b = j + self.window
            if b >= 0:
                yield (_SPAN, 0, *place[:2], place[2] + a, place[2] + b, None)


def count(batches: Iterator[pa.RecordBatch], window: int = WINDOW, limit: int = BUCKET_LIMIT) -> Iterator[pa.RecordBatch]:
    """Parcels sorted by bucket to removed spans; groups that a bucket can't hold come out as windows."""
    now, bucket, out = None, Bucket(window, limit), []
    for part in tidy(batches):
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if row[0] == _SPAN:
                out.append(row)
            else:
                if row[1] != now:
                    out.extend(bucket.spans())
                    now, bucket = row[1], Bucket(window, limit)
                for w in bucket.add(row[6]):
                    out.append(w)
                    if len(out) >= 20_000:
                        yield batch(out)
                        out = []
            if len(out) >= 20_000:
                yield batch(out)
                out = []
    out.extend(bucket.spans())
    for i in range(0, len(out), 20_000):
        yield batch(out[i : i + 20_000])


def count_windows(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Windows sorted by hash and position to removed spans: of equal ones all but the first position."""
    now, first_of = None, {}
    for part in batches:
        out = []
        for _, key, d, t, first, _, w in zip(*(c.to_pylist() for c in part.columns), strict=True):
            if key != now:
                now, first_of = key, {}
            if first_of.setdefault(w, (d, t, first)) != (d, t, first):
                out.append((_SPAN, 0, d, t, first, first + window, None))
        yield batch(out)


def removed_spans(docs: DataFrame, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """(d, t, first, last): spans of words to remove, the end excluded.  ``docs`` has d, t (a hash of the text) and text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-3 * total // bucket_bytes))  # a word travels about three times
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * total // TASK_BYTES))
    sent = docs.mapInArrow(lambda b: split(b, buckets, window), _SCHEMA)
    once = saved(sent.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(lambda b: count(b, window, bucket_limit), _SCHEMA))
    again = once.where(F.col("kind") == _WINDOW).repartition("key").sortWithinPartitions("key", "d", "t", "first").mapInArrow(lambda b: count_windows(b, window), _SCHEMA)
    return once.where(F.col("kind") == _SPAN).unionByName(again).select("d", "t", "first", "last")


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True, bucket_bytes: int = BUCKET_BYTES, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, text (the kept words joined by blanks).

    A null text has no words.  Texts shorter than a window keep all words.  Rows with the same id and the same
    text are one document given twice and get the same result; with the same id and other texts they are ordered
    by a hash of the text.  A null id comes before all others.  Other columns are ignored, whatever their names.  An
    empty table gives no rows.
    """
    tune(docs.sparkSession)
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("d", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("t", F.hash("text").cast("long"))
    spans = removed_spans(base.select("d", "t", "text"), window, bucket_bytes, bucket_limit).groupBy("d", "t").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
    joined = base.join(spans, ["d", "t"], "left").select("doc_id", "text", "spans")
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["text"] * keep_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 4_000_000):
            cols: list[list] = [[] for _ in range(4)]
            for text, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                words = WORD.findall(text or "")
                kept = words
                if spans:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, [s["first"] for s in spans], 1)
                    np.add.at(gone, [s["last"] for s in spans], -1)
                    kept = [w for w, g in zip(words, np.cumsum(gone).tolist(), strict=False) if not g]
                left = " ".join(kept)
                for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(left.encode("utf-8", "surrogatepass")).hexdigest(), left), strict=True):
                    c.append(v)
            arrays = [part.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays[: len(names)], names=names)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * keep_text)
