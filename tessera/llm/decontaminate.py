"""Benchmark decontamination by pigeonhole edit matching.

An item of ``m`` characters may differ from a document's passage by ``k`` edits.  Split into ``k + 1``
pieces, at least one piece occurs unchanged in such a passage, so an Aho-Corasick automaton over the
pieces finds every candidate place.  Each place is verified with Myers' bit-parallel edit distance
(the item is the pattern, the place widened by ``k`` on both sides is the text).

Texts are compared in lower case with runs of white space as one space.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import saved, slices, tune

#: Share of an item's characters that may be edited.
ERROR_RATE = 0.08
#: Characters of benchmark text that are sent to the executors at once; a larger benchmark is
#: matched in several passes.
BLOCK_CHARS = 2_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    """Edits allowed for an item of so many characters."""
    return int(length * error_rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k + 1`` pieces of nearly equal length with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = {}
    for i, c in enumerate(pattern):
        found[c] = found.get(c, 0) | 1 << i
    return found


def best_match(peq: dict[str, int], m: int, text: str, k: int) -> tuple[int, int] | None:
    """Least edit distance of the pattern to any substring of ``text`` and the substring's end; None above ``k``."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, k + 1, 0
    get = peq.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= k else None


class Matcher:
    """The automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float):
        import ahocorasick

        self.items = {}
        owners: dict[str, list[tuple[int, int]]] = {}
        for n, (item_id, raw) in enumerate(items):
            text = normal(raw)
            if not text:
                continue
            k = budget(len(text), error_rate)
            self.items[n] = (item_id, text, k, masks(text))
            for at, piece in pieces(text, k):
                owners.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, who in owners.items():
            self.automaton.add_word(piece, (len(piece), who))
        if owners:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end in the normal form of the text) of each item found, its best place."""
        if not self.items or not text:
            return []
        text = normal(text)
        places: dict[int, set[int]] = {}
        for end, (size, who) in self.automaton.iter(text):
            for n, at in who:
                places.setdefault(n, set()).add(end + 1 - size - at)
        found = []
        for n, starts in places.items():
            item_id, item, k, peq = self.items[n]
            m, best, done = len(item), None, -1
            for start in sorted(starts):
                low, high = max(0, start - k), min(len(text), start + m + k)
                if high <= done or high - low < m - k:
                    continue
                if text[max(0, start) : start + m] == item:
                    best = (0, start + m)
                    break
                # neighbouring diagonals are verified in one window
                hit = best_match(peq, m, text[low : high + k], k)
                done = high + k
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low + hit[1])
            if best:
                found.append((item_id, *best))
        return sorted(found)


def item_blocks(benchmark: DataFrame, item_id: str, item_text: str, block_chars: int) -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """How many blocks of about ``block_chars`` characters the items make (one at least), and the blocks, fetched one by one.

    Items are dealt by a hash, so a block may be somewhat longer.
    """
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t is not null")
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    return blocks, ([tuple(r) for r in items.where(F.pmod(F.xxhash64("t", "i"), F.lit(blocks)) == b).collect()] for b in range(blocks))


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, distance, end_char, error_budget.

    ``end_char`` is the end of the best place in the document's normal form.  Null or empty documents and
    items match nothing; repeated documents or items give a row each; a null id stays null.  Other columns
    of either table are ignored; of equally good places the first counts; an empty table on either side gives no rows.
    The driver holds one block of about ``block_chars`` characters of items at a time (one pass over the documents for
    each; where there are several, what a pass finds is stored before the next).
    """
    tune(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    out = None
    n_blocks, blocks = item_blocks(benchmark, item_id, item_text, block_chars)
    for block in blocks:

        def match(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            lengths = {}
            for n in matcher.items.values():
                lengths.setdefault(n[0], n[2])
            for batch in slices(batches, "t", 2_000_000):
                out = [(d, i, dist, end, lengths[i]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for i, dist, end in matcher.matches(t)]
                cols = list(zip(*out, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "distance", "end_char", "error_budget"])

        part = source.mapInArrow(match, "doc_id long, item_id long, distance long, end_char long, error_budget long")
        part = part if n_blocks == 1 else saved(part)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, all columns kept (row by row, without a shuffle).

    Null and empty texts stay; repeated rows stay or go together; other columns don't matter; an empty benchmark
    takes nothing away, and an empty table gives no rows.  A benchmark of several blocks is matched in as many passes, and
    what each leaves is stored.
    """
    tune(docs.sparkSession)
    out = docs
    n_blocks, blocks = item_blocks(benchmark, item_id, item_text, block_chars)
    for block in blocks:

        def keep(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(block, error_rate)
            for batch in slices(batches, text, 2_000_000):
                yield batch.filter(pa.array([not matcher.matches(t or "") for t in batch.column(text).to_pylist()], pa.bool_()))

        out = out.mapInArrow(keep, docs.schema)
        if n_blocks > 1:
            out = saved(out)
    return out
