"""Packing of tokenized documents into sequences of a fixed length by swap-based local search.

1. Documents become tokens plus an end id.  Only a longer one is cut; its first piece takes the remainder, so
   all others are full and each is a sequence of its own.
2. Of the rest only the lengths matter.  Their histogram has at most ``capacity - 1`` numbers however many
   documents there are; bins of equal content are one pattern with a multiplicity, so packing happens on the
   driver in memory that doesn't grow with the data.  A plain packing in the order of the lengths is improved by
   local search: documents are moved, exchanged one for one, or two for one between underfull bins as long as the
   sum of squared fills grows, which empties bins.  Partners are looked up by the difference that is needed, and
   an exchange is made in as many bins as both patterns have.
3. Every piece gets its rank among the pieces of its length, and by length and rank its bin and place.  Ranks
   come from salted groups (a group and the number of a length's groups grow with the square root of its
   count) and running totals of their sizes, so a length with very many pieces is dealt out too.
"""

from __future__ import annotations

import sys
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import saved, slices, tune

CAPACITY = 1024
END_ID = 2
#: Pieces of one length in one salted group, about (the square root of their number, if that is more).
GROUP_ROWS = 200

#: How the byte-level BPE cuts a text into words (fixed value, it belongs to the vocabulary).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


def byte_alphabet() -> dict[str, int]:
    """The characters by which a byte-level vocabulary writes bytes: printable ones stand for themselves."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteTokenizer:
    """The byte-level BPE of a ``tokenizers`` file, as ``Tokenizer.encode(text, add_special_tokens=False)`` gives it.

    The vocabulary is read from the file.  Its ids are the ranks of its merges, so tiktoken's merge loop gives
    the same ids in a fraction of the time; that is checked on loading.  A special token's string in a text is that
    token's id, as an unchanged ``Tokenizer`` reads it; with ``special`` false it is ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        import tiktoken
        from tokenizers import Tokenizer

        reader = Tokenizer.from_file(path)
        reader.encode_special_tokens = not special
        alphabet = byte_alphabet()
        added = reader.get_added_tokens_decoder()
        if any(t.single_word or t.lstrip or t.rstrip or any(o.content != t.content and o.content.startswith(t.content) for o in added.values()) for t in added.values()):
            raise ValueError(f"{path} has special tokens that are more than their strings")
        special_ids = {t.content: i for i, t in added.items()}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in reader.get_vocab().items() if token not in special_ids}
        encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special_ids)
        allowed = set(special_ids)
        self._encode = (lambda text: encoding.encode(text, allowed_special=allowed, disallowed_special=())) if special else encoding.encode_ordinary
        probe = "Don't stop:  it's\n\n 12,345 \u00e9t\u00e9s \u4f60\u597d \t<|endoftext|> ok"
        if self._encode(probe) != reader.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} is no byte-level BPE whose ids are ranks")

    def encode(self, text: str) -> bytes:
        """The ids, little-endian unsigned 32-bit."""
        ids = array("I", self._encode(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()


@lru_cache(2)
def shared_tokenizer(path: str) -> ByteTokenizer:
    """One for all tasks of a worker."""
    return ByteTokenizer(path)


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of each piece of n tokens: the first may be shorter, all others are full."""
    first = n % capacity or capacity
    yield 0, min(first, n)
    for start in range(first, n, capacity):
        yield start, capacity


def pieces(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row: doc_id, piece, start, length, ids_crc32, and with ``keep_ids`` the ids themselves."""
    tune(docs.sparkSession)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = shared_tokenizer(tokenizer_path)
        for batch in slices(batches, "t", 1_000_000):
            cols: list[list] = [[] for _ in names]
            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = tokenizer.encode(t or "") + end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (d, k, start, length, zlib.crc32(part), part), strict=False):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)


Pattern = tuple[int, ...]


def first_packing(histogram: dict[int, int], capacity: int) -> Counter[Pattern]:
    """A plain packing by pattern: documents in the order of their lengths, a new bin where the next one doesn't fit."""
    bins: Counter[Pattern] = Counter()
    now, room = [], capacity
    for n, count in sorted(histogram.items(), reverse=True):
        k = min(count, room // n)
        now, room, count = now + [n] * k, room - n * k, count - k
        if not count:
            continue
        if now:
            bins[tuple(now)] += 1
        per = capacity // n
        bins[(n,) * per] += count // per
        now, room = [n] * (count % per), capacity - n * (count % per)
    if now:
        bins[tuple(now)] += 1
    return +bins


_NONE = 1 << 30


class Reach:
    """What underfull bins can take in: by reach (their room plus what they give back) what they give and who they are.

    A bin that gives ``t`` back and takes ``s`` in leaves ``reach - s`` tokens free and gains if ``t < s``.  So the best
    partner for ``s`` stands at the least reach from ``s`` on whose least ``t`` is under ``s``.
    """

    def __init__(self, capacity: int):
        self.at: list[dict[int, dict[Pattern, None]]] = [{} for _ in range(2 * capacity + 1)]
        self.least = np.full(3 * capacity + 2, _NONE, np.int64)

    def add(self, reach: int, t: int, p: Pattern) -> None:
        self.at[reach].setdefault(t, {})[p] = None
        self.least[reach] = min(t, self.least[reach])

    def drop(self, reach: int, t: int, p: Pattern) -> None:
        who = self.at[reach][t]
        del who[p]
        if not who:
            del self.at[reach][t]
            if self.least[reach] == t:
                self.least[reach] = min(self.at[reach], default=_NONE)


def _gifts(pattern: Pattern) -> tuple[list[int], dict[int, Pattern]]:
    """The lengths in a bin, and by their sum two of its documents (sums that are a length too are left out)."""
    counts = Counter(pattern)
    one, two = list(counts), {}
    for i, x in enumerate(one):
        if counts[x] > 1:
            two.setdefault(2 * x, (x, x))
        for y in one[i + 1 :]:
            two.setdefault(x + y, (x, y))
    return one, {s: xy for s, xy in two.items() if s not in counts}


def _without(pattern: Pattern, gone: Pattern, new: Pattern) -> Pattern:
    return tuple(sorted((Counter(pattern) - Counter(gone) + Counter(new)).elements(), reverse=True))


def improve(bins: Counter[Pattern], capacity: int) -> Counter[Pattern]:
    """Local search between underfull bins, the emptiest first, until no exchange is left.

    A bin gives one document, or two, and gets back none, one, or (for one) two shorter in sum, wherever the
    sum of squared fills grows; of its exchanges the one is made that leaves its partner least room, in as many bins
    as both patterns have.  Every exchange raises that sum, so the search ends; nothing caps it.
    """
    bins = Counter(+bins)
    for_one, for_two = Reach(capacity), Reach(capacity)  # what is given back for one document, and for two
    known: dict[Pattern, tuple[int, list[int], dict[int, Pattern]]] = {}  # underfull patterns: fill and gifts

    def places(p: Pattern) -> Iterator[tuple[Reach, int, int]]:
        fill, one, two = known[p]
        for t in (0, *one):
            yield for_one, capacity - fill + t, t
            yield for_two, capacity - fill + t, t
        for t in two:
            yield for_one, capacity - fill + t, t

    def enter(p: Pattern) -> None:
        if p not in known and sum(p) < capacity:
            known[p] = (sum(p), *_gifts(p))
            for index, reach, t in places(p):
                index.add(reach, t, p)

    def leave(p: Pattern) -> None:
        if p in known:
            for index, reach, t in places(p):
                index.drop(reach, t, p)
            del known[p]

    def exchange(a: Pattern) -> tuple[Pattern, Pattern, Pattern] | None:
        """(partner, given, given back): the exchange of ``a`` that leaves its partner least room."""
        fill, one, two = known[a]
        best, free = None, capacity - fill  # with as much room left as ``a`` has the squares don't grow
        for s, given, index in [*((s, (s,), for_one) for s in one), *((s, xy, for_two) for s, xy in two.items())]:
            good = index.least[s : s + free] < s
            k = int(good.argmax()) if free else 0
            if free and good[k]:
                best, free = (s, given, index), k
        if best is None:
            return None
        s, given, index = best
        t = int(index.least[s + free])
        b = next(iter(index.at[s + free][t]))
        return b, given, () if not t else (t,) if t in b else known[b][2][t]

    for p in sorted(bins):
        enter(p)
    changed = True
    while changed:
        changed = False
        heap = sorted((fill, p) for p, (fill, _, _) in known.items())
        while heap:
            _, a = heappop(heap)
            if a not in known:
                continue
            own = known[a]
            if bins[a] == 1:  # not its own partner
                leave(a)
                known[a] = own
                found = exchange(a)
                del known[a]
                enter(a)
            else:
                found = exchange(a)
            if found is None:
                continue
            changed = True
            b, given, back = found
            times = bins[a] // 2 if a == b else min(bins[a], bins[b])
            bins[a] -= times
            bins[b] -= times
            after = {_without(a, given, back), _without(b, back, given)}
            for p in (_without(a, given, back), _without(b, back, given)):
                if p:
                    bins[p] += times
            for p in {a, b}:
                if not bins[p]:
                    del bins[p]
                    leave(p)
            for p in sorted({a, b} | after):
                if bins[p]:
                    enter(p)
                    if p in known:
                        heappush(heap, (known[p][0], p))
    return +bins


def plan(histogram: dict[int, int], capacity: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks of its runs, and for each run the bin of its first rank and the place in the bin."""
    bins = improve(first_packing(histogram, capacity), capacity)
    rank: Counter[int] = Counter()
    runs: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for pattern, times in sorted(bins.items()):
        at = 0
        for n in pattern:
            runs.setdefault(n, []).append((rank[n], base, at))
            rank[n] += times
            at += n
        base += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for n, r in runs.items()}


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset.  They must be stored (a table or a checkpoint), as they are read twice."""
    full = pieces.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = pieces.where(F.col("length") < capacity)
    histogram = {r[0]: r[1] for r in rest.groupBy("length").count().collect()}
    if not histogram:
        return full
    runs = plan(histogram, capacity)
    salts = np.ones(capacity, np.int64)
    for n, c in histogram.items():
        salts[n] = -(-c // max(GROUP_ROWS, isqrt(c)))
    salted = rest.withColumn("__salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.element_at(F.array(*map(F.lit, salts.tolist())), F.col("length").cast("int") + 1)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    group = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(before, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.row_number().over(group) - 1).drop("__salt", "__before")
    names = [*pieces.columns, "__rank"]
    ranked = ranked.select(*names)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(names.index("length")).to_numpy()
            rank = batch.column(len(names) - 1).to_numpy()
            bin_, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = np.nonzero(length == n)[0]
                first, base, place = runs[int(n)]
                k = np.searchsorted(first, rank[rows], "right") - 1
                bin_[rows] = base[k] + rank[rows] - first[k]
                at[rows] = place[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bin_), pa.array(at)], names=[*names[:-1], "sequence_id", "offset"])

    return full.unionByName(ranked.mapInArrow(place, full.schema))


def pack(docs: DataFrame, tokenizer_path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null texts are empty: a piece of the end id alone.  Repeated rows are packed once each; other columns are
    ignored; an empty table gives no rows.  The pieces without their ids are stored in the shared folder.
    """
    return assign(saved(pieces(docs, tokenizer_path, doc_id=doc_id, text=text, capacity=capacity, end_id=end_id, keep_ids=keep_ids)), capacity)
