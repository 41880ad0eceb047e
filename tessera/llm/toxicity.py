"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text.  Every window of eight words is
compressed with both; how many bytes the toxic dictionary saves against the ordinary one is the window's
gain.  A document's gains are summed up in a few numbers, and a logistic calibration, fitted on labelled rows
that the dictionaries of their fold have not seen, turns these into a score between 0 and 1.

What makes the lengths comparable to the byte:

* Most words of a toxic document are ordinary.  The toxic dictionary's own part is therefore trained on those parts
  of toxic text that are many times as frequent there (by document frequency of byte 5-grams); trained on whole
  windows of toxic documents it mostly learns ordinary words, and finds less than half as much.
* Both dictionaries end in the same shared part, trained on ordinary windows, so ordinary text costs the same.
* Every window is preceded by a fixed primer that stands in the shared part.  Its match pays for zstandard's
  block headers, so a single further match already shows in the length.

Windows are of whole words and do not overlap; whole texts are scored, of any length.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, tune

WINDOW = 8
#: Bounds of the training sample: labelled rows of each class, characters of all, and windows of ordinary text that
#: the shared part is trained on.
SAMPLE_TOXIC = 2500
SAMPLE_ORDINARY = 5000
SAMPLE_CHARS = 30_000_000
SAMPLE_WINDOWS = 150_000
SHARED_BYTES = 8192
#: A dictionary's own part: as much as there is typical toxic text (repeats aside), at least and at most.
OWN_BYTES, MAX_OWN_BYTES = 1024, 16384
#: A byte 5-gram marks toxic text if its document frequency there is so many times the ordinary one.
CONTRAST = 20
GRAM = 5
PRIMER = bytes((i * 37 + 11) % 128 + 128 for i in range(48))
THRESHOLD = 0.7
#: Folds of the calibration.
FOLDS = 3


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The text's windows, at least one."""
    w = words(text)
    return [PRIMER + (" " + " ".join(w[i : i + size]) + " ").encode("utf-8", "surrogatepass") for i in range(0, max(1, len(w)), size)]


def compressor(content: bytes) -> zstd.ZstdCompressor:
    params = zstd.ZstdCompressionParameters(strategy=zstd.STRATEGY_LAZY2, min_match=5, window_log=17, hash_log=14, chain_log=14, search_log=4, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)
    dictionary = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
    dictionary.precompute_compress(compression_params=params)
    return zstd.ZstdCompressor(dict_data=dictionary, compression_params=params)


def grams(text: str) -> set[bytes]:
    found = set()
    for w in set(words(text)):
        b = f" {w} ".encode("utf-8", "surrogatepass")
        found.update(b[i : i + GRAM] for i in range(len(b) - GRAM + 1))
    return found


def runs(text: str, marks: set[bytes]) -> Iterator[bytes]:
    """The longest parts of words all of whose n-grams are in ``marks``."""
    for w in words(text):
        b, i = f" {w} ".encode("utf-8", "surrogatepass"), 0
        while i <= len(b) - GRAM:
            if b[i : i + GRAM] in marks:
                j = i
                while b[j + 1 : j + 1 + GRAM] in marks:
                    j += 1
                yield b[i : j + GRAM]
                i = j + GRAM
            else:
                i += 1


def dictionary(samples: list[bytes], size: int) -> bytes:
    """The content of a trained zstandard dictionary; too few samples to train on are taken as they are."""
    try:
        return zstd.train_dictionary(size, samples, k=24, d=6, f=18, split_point=1.0, steps=0, accel=1).as_bytes()
    except zstd.ZstdError:
        return b"".join(sorted(set(samples)))[-size:]


@dataclass
class Model:
    toxic: bytes
    ordinary: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(5))
    centre: np.ndarray = field(default_factory=lambda: np.zeros(4))
    scale: np.ndarray = field(default_factory=lambda: np.ones(4))

    def __post_init__(self):
        self._pair = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"} | {"_pair": None}

    def features(self, texts: list[str | None]) -> np.ndarray:
        """For each text: largest gain, log of the sum of gains of 2 bytes or more, log of how many, log of all windows."""
        if self._pair is None:
            self._pair = (compressor(self.ordinary), compressor(self.toxic))
        all_, ends = [], []
        for t in texts:
            all_ += windows(t)
            ends.append(len(all_))
        a, b = (np.fromiter((len(x) for x in c.multi_compress_to_buffer(all_)), np.int64, len(all_)) for c in self._pair)
        gain = a - b
        starts = np.concatenate(([0], ends[:-1])).astype(np.int64)
        big = np.where(gain >= 2, gain, 0)
        return np.stack([np.maximum.reduceat(gain, starts), np.log1p(np.add.reduceat(big, starts)), np.log1p(np.add.reduceat(big > 2, starts, dtype=np.int64)), np.log(np.diff(np.concatenate((starts, [len(all_)]))))], 1).astype(float)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = (self.features(texts) - self.centre) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -30, 30)))


def dictionaries(rows: list[tuple[str, int]], rng: random.Random, max_windows: int = SAMPLE_WINDOWS) -> Model:
    """The two dictionaries from labelled rows, not calibrated yet; the shared part learns from ``max_windows`` windows."""
    toxic = [t for t, y in rows if y]
    ordinary = [t for t, y in rows if not y]
    in_toxic, in_ordinary = Counter(), Counter()
    for t in toxic:
        in_toxic.update(grams(t))
    for t in ordinary:
        in_ordinary.update(grams(t))
    least = max(2, 0.01 * len(toxic))
    marks = {g for g, n in in_toxic.items() if n >= least and (n + 0.5) / (len(toxic) + 1) >= CONTRAST * (in_ordinary[g] + 0.5) / (len(ordinary) + 1)}
    marked = [r for t in toxic for r in runs(t, marks)]
    plain = [w[len(PRIMER) :] for t in ordinary for w in windows(t, 2 * WINDOW)]
    rng.shuffle(marked)
    rng.shuffle(plain)
    repeated = Counter(marked)
    size = min(MAX_OWN_BYTES, max(OWN_BYTES, sum(len(r) for r, n in repeated.items() if n >= least)))
    base = dictionary(plain[:max_windows], SHARED_BYTES + size)
    own = dictionary(marked, size)[-size:]
    shared = base[-SHARED_BYTES:] + PRIMER
    return Model(own.rjust(size, b" ") + shared, base[:-SHARED_BYTES][-size:].rjust(size, b" ") + shared)


def train(texts: list[str], labels: list[int], seed: int = 0) -> Model:
    """Dictionaries from all rows, the calibration from rows that the dictionaries of its fold have not seen.

    Repeated rows count once.  Without rows of both classes nothing can be learned, and every text scores 0.
    """
    rows = sorted(set(zip(texts, labels, strict=True)))
    rng = random.Random(seed)
    rng.shuffle(rows)
    if min(sum(1 for _, y in rows if y), sum(1 for _, y in rows if not y)) < 1:
        return Model(PRIMER, PRIMER, np.array([-30.0, 0, 0, 0, 0]))
    x, y = [], []
    for k in range(FOLDS):
        part = dictionaries([r for i, r in enumerate(rows) if i % FOLDS != k], rng)
        rest = rows[k::FOLDS]
        x += [part.features([t for t, _ in rest[i : i + 200]]) for i in range(0, len(rest), 200)]
        y += [label for _, label in rest]
    model = dictionaries(rows, rng)
    x, y = np.concatenate(x), np.array(y, float)
    model.centre, model.scale = x.mean(0), x.std(0) + 1e-6
    z = np.hstack([np.ones((len(x), 1)), (x - model.centre) / model.scale])
    w = np.zeros(5)
    for _ in range(30):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-6, 1, 1, 1, 1])
        w -= np.linalg.solve(h, z.T @ (p - y) + np.array([0, 1, 1, 1, 1]) * w)
    model.weights = w
    return model


def remainder(doc_id: str, parts: int = 3) -> Column:
    """crc32 of the id as text, modulo ``parts``: the fold of a document."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(parts))


def sample(docs: DataFrame, labels: DataFrame, held_out: Column, *, toxic: int = SAMPLE_TOXIC, ordinary: int = SAMPLE_ORDINARY, chars: int = SAMPLE_CHARS) -> list[tuple[str, int]]:
    """A bounded sample of labelled rows that are not held out, chosen by a hash of the id.

    About ``toxic`` and ``ordinary`` rows of the two classes at most, and ``chars`` characters in all.  Null ids, labels and
    texts are left out; of a label given twice the higher counts; an empty table gives no rows.
    """
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    order = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1_000_000))
    share = {y: min(1.0, most / max(1, counts.get(y, 0))) for y, most in ((1, toxic), (0, ordinary))}

    def rows(part: float) -> DataFrame:
        keep = F.lit(False)
        for y, s in share.items():
            keep |= (F.col("toxic") == y) & (order <= int(s * part * 1_000_000))
        # some thousands of ids: the bound above
        few = F.broadcast(marked.where(keep))
        return docs.select("doc_id", "text").where("text is not null").join(few, "doc_id").select("text", "toxic")

    there = rows(1.0).agg(F.sum(F.length("text"))).first()[0] or 0
    return sorted((r[0], r[1]) for r in rows(min(1.0, chars / max(1, there))).collect())


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, score (0 to 1) and predicted (1 from 0.7 on).

    Null and empty texts are one empty window.  Repeated rows give repeated rows, equal texts equal scores; other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "t", 2_000_000):
            s = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns kept (row by row, without a shuffle).

    Null and empty texts are judged as one empty window; repeated rows stay or go together; other columns don't
    matter; an empty table gives no rows.
    """
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, 2_000_000):
            yield batch.filter(pa.array(model.scores(batch.column(text).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
