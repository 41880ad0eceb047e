"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's letters are lower-cased, everything else becomes one separator, and every run of 2, 3 and 4
code points is hashed to a row of an embedding table.  A text is the mean of its rows, a linear layer and a
softmax give the languages.  Embeddings and layer are trained together by stochastic gradient descent in
numpy.  A temperature, fitted on a part of the sample that training does not see, calibrates the scores, and
the rejection threshold is the least score at which the accepted part of it is as accurate as asked for.

As the layer is linear, the mean of embeddings times the layer equals the mean of one small row of logits
per bucket; only that table (buckets x languages, a fixed size) travels to the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, tune

BUCKETS = 1 << 16
DIM = 16
GRAMS = (2, 3, 4)
#: Bounds of the training sample: rows of each language, and characters of all.
SAMPLE_ROWS = 1200
SAMPLE_CHARS = 20_000_000
EPOCHS = 4
#: Code points that are looked at together, and logits that are held for them.
PART = 1 << 17
CELLS = 4_000_000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


def codes(text: str) -> np.ndarray:
    """Lower-case letters as code points (32 bits), runs of anything else as one 0, and 0 at both ends; a long text part by part."""
    parts, zero = [np.zeros(1, np.uint32)], True  # whether the last one is 0
    for begin in range(0, len(text), PART):
        a = np.frombuffer(text[begin : begin + PART].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        a = np.where(letters()[a], a, np.uint32(0))
        a = a[(a != 0) | np.concatenate(([not zero], a[:-1] != 0))]
        if len(a):
            parts.append(a)
            zero = a[-1] == 0
    return np.concatenate(parts if zero else [*parts, np.zeros(1, np.uint32)])


def grams(a: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets of all n-grams) of the code points."""
    a = a.astype(np.uint64)
    h = a
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(0x9E3779B1) + a[n - 1 :] if len(h) > 1 else h[:0]
        if n in GRAMS:
            yield n, ((h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(64 - 16)).astype(np.int64)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # logits by bucket, float32
    bias: np.ndarray
    temperature: float
    reject_below: float

    def logits(self, texts: list[str]) -> np.ndarray:
        """A row of logits for each text."""
        arrays = [codes(t) for t in texts]
        out = np.zeros((len(texts), len(self.langs)))
        total = np.zeros(len(texts))
        whole = np.concatenate(arrays)
        sizes = np.array([len(a) for a in arrays])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # a stretch of code points at a time: a row of logits for each of them has to fit
        stretch = min(PART, max(1024, CELLS // max(1, len(self.langs))))
        for begin in range(0, len(whole), stretch):
            stop = min(begin + stretch, len(whole))
            first, last = np.searchsorted(ends, begin, "right"), np.searchsorted(starts, stop, "left")
            for n, buckets in grams(whole[begin : stop + max(GRAMS) - 1]):
                # grams that begin in the last n - 1 places of a text reach into the next one
                low = np.clip(starts[first:last] - begin, 0, len(buckets))
                high = np.clip(np.minimum(ends[first:last] - n + 1, stop) - begin, low, len(buckets))
                sums = np.concatenate((np.zeros((1, len(self.langs))), np.cumsum(self.table[buckets[: stop - begin]], axis=0, dtype=np.float64)))
                out[first:last] += sums[np.minimum(high, len(sums) - 1)] - sums[np.minimum(low, len(sums) - 1)]
                total[first:last] += high - low
        return out / np.maximum(total, 1)[:, None] + self.bias

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        p = softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        return [(self.langs[b], float(p[i, b])) for i, b in enumerate(best)]


def train(texts: list[str], langs: list[str], *, seed: int = 0, epochs: int = EPOCHS, accuracy: float = 0.99) -> Model:
    """Train on all but a tenth of the rows, calibrate on that tenth (where it has less than 20 rows, on all).

    One language alone is predicted with score 1.  Without rows nothing is learned and everything is ``und``.
    """
    if not texts:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs])
    rng = np.random.default_rng(seed)
    emb = (rng.random((BUCKETS, DIM), np.float32) - 0.5) / DIM
    layer = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    bags = []
    for t in texts:
        all_ = np.concatenate([g for _, g in grams(codes(t))])
        ids, n = np.unique(all_, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    order = rng.permutation(len(texts))
    held = order[: len(order) // 10]
    fit = order[len(order) // 10 :]
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(fit):
            ids, w = bags[i]
            rate = np.float32(1.0 * (1 - done / steps))
            done += 1
            if not len(ids):
                continue
            hidden = w @ emb[ids]
            g = softmax(hidden @ layer + bias)
            g[y[i]] -= 1
            back = layer @ g
            layer -= rate * np.outer(hidden, g)
            bias -= rate * np.float32(0.01) * g
            emb[ids] -= (rate * w[:, None]) * back[None, :] * np.float32(len(ids) ** 0.5)
    model = Model(names, (emb @ layer).astype(np.float32), bias, 1.0, 0.0)
    sample = held if len(held) >= 20 else order
    raw = np.concatenate([model.logits([texts[i]]) for i in sample])
    truth = y[sample]
    grid = [2.0**k for k in np.arange(-3, 3.1, 0.25)]
    loss = [-np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(loss))])
    p = softmax(raw / model.temperature)
    top, right = p.max(1), p.argmax(1) == truth
    by = np.argsort(-top)
    good = np.cumsum(right[by]) / np.arange(1, len(by) + 1) >= accuracy
    model.reject_below = float(top[by][np.nonzero(good)[0][-1]]) if good.any() else 1.0
    return model


def sample(docs: DataFrame, text: str, lang: str, where: Column, doc_id: str, *, rows_each: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled rows: by a hash of the id, about ``rows_each`` of each language and ``chars`` characters in all.

    No language is left out; null texts and languages are; an empty table gives no rows.
    """
    rows = docs.where(where & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("l")).agg(F.count("*").alias("n"), F.sum(F.length(text)).alias("c")).collect()
    if not counts:
        return []
    share = chars / len(counts)
    below = [(r.l, int(min(1.0, rows_each / r.n, share / max(1, r.c)) * 1_000_000) + 1) for r in counts]
    bounds = docs.sparkSession.createDataFrame(below, "__lang string, __below long")
    at = F.pmod(F.xxhash64(F.lit("language sample"), F.col(doc_id)), F.lit(1_000_000))
    found = rows.join(F.broadcast(bounds), (F.col(lang) == F.col("__lang")) & (at < F.col("__below"))).select(text, lang).collect()
    return sorted((r[0], r[1]) for r in found)


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score (calibrated probability) and rejected (score below the threshold).

    Null texts and texts without a letter get ``und``, score 0 and are rejected.  Whole texts are used, of any
    length.  Of equally likely languages the first by name counts.  Repeated rows give repeated rows; other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 2_000_000):
            texts = batch.column(1).to_pylist()
            known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
            out: list[tuple[str, float, bool]] = [(UNKNOWN, 0.0, True)] * len(texts)
            if known:
                for i, (name, p) in zip(known, model.predict([texts[i] for i in known]), strict=True):
                    out[i] = (name, p, p < model.reject_below)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out]), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())], names=["doc_id", "lang_pred", "score", "rejected"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def remainder(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a document."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))
