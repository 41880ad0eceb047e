"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded and verified.

* A document's features are its runs of five words (lower case, split at white space; a shorter text is one
  run).  A feature's weight is its count times its inverse document frequency, 1 + ln((1 + N) / (1 + df)) / ln(2 + N).
  The logarithm is scaled, so that what a large group of copies shares doesn't become weightless against what tells
  them apart: unscaled, near copies in a group of a third of all rows can fall under the threshold, share their buckets all
  the same, and their comparison grows with the square of the group.
  Document frequencies count all documents, in a count-min sketch of ``DF_ROWS`` rows: what is read of it is never
  under the true number, and over it by a small share of N (some 450 shingles a document in 2**20 cells: 0.0004 N).
  The sketch doubles for every fourfold corpus, so that share falls as the corpus grows.
* 36 samples of improved consistent weighted sampling (Ioffe 2010) in 12 bands of 3: two texts with weighted
  Jaccard similarity s share a band with probability 1 - (1 - s**3)**12, 0.9998 at 0.8.  A sample's three random
  variables come from three 16-bit parts of a feature's hash, each through the inverse of its distribution.
* Equal texts are one node.  In every bucket the members are verified against its hubs (the member that shares
  most buckets and two others); links make components.  In a bucket whose members are not all in one component by then,
  what could still join two of them is verified too: all pairs across components in a small bucket, and in
  a large one everything outside its main component against all members, dealt out in blocks (once for
  all buckets of that component).  So each pair
  that shares a band is verified unless its documents are in one class already, and no group's pairs are
  spelled out.
* Verification computes the weighted Jaccard similarity of the whole texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, stored, tidy, tune
from tessera.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 3
#: The sketch of document frequencies: rows, and cells of a row as powers of two (what is sent to each executor: 2 bytes a cell).
DF_ROWS = 2
DF_BITS, MAX_DF_BITS = 20, 24
CHUNKS = 64
#: Members of a bucket of which all pairs across components are verified; larger ones are dealt out in blocks.
SMALL = 24
BLOCK = 96
#: Pairs of blocks to a task, and tasks at most.
GROUPS_TO_TASK = 4
MAX_PARTS = 20_000
#: Slots of the hashed semi-join that fetches candidate texts.
SLOTS = 1 << 18
#: Words whose hashes a worker remembers.
REMEMBERED = 150_000
#: Features of documents that a verifying worker remembers.
KNOWN_FEATURES = 1_000_000
#: Places of a block's index that are looked at at once.
PLACES = 1_000_000
SEED = 20100


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def shingles(w: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their counts."""
    if not w:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    size = min(SHINGLE, len(h))
    g = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(g)]
    return np.unique(mixed(g), return_counts=True)


def sketch_bits(documents: int) -> int:
    """Cells of a row of the sketch, as a power of two: 2**20 up to two million documents, twice as many for every four times."""
    bits = DF_BITS
    while bits < MAX_DF_BITS and documents > 2 << 20 + 2 * (bits - DF_BITS):
        bits += 1
    return bits


def cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each shingle in a row of the sketch."""
    if row:
        h = h * np.uint64(0x9FB21C651E98DF25 + 2 * row)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def document_frequencies(docs: DataFrame, bits: int = DF_BITS) -> tuple[np.ndarray, int]:
    """(log2 of 1 + document frequency, in 1/1024, by row and cell; documents with words) over all rows; ``docs`` has text."""
    size = (1 << bits) // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, n = WordHashes(), np.zeros((DF_ROWS, 1 << bits), np.int32), 0
        for batch in slices(batches, "text", 4_000_000):
            found = [h for t in batch.column(0).to_pylist() if len(h := shingles(words(t), hashes)[0])]
            n += len(found)
            if found:
                h = np.concatenate(found)
                for row in range(DF_ROWS):
                    np.add.at(total[row], cells(h, row, bits), 1)
        squeeze = zstd.ZstdCompressor(level=1)
        if n:
            flat = total.ravel()
            parts = [squeeze.compress(flat[i * size : (i + 1) * size].tobytes()) for i in range(CHUNKS * DF_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary()), pa.array([n] + [0] * (len(parts) - 1), pa.int64())], names=["chunk", "data", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        ns: dict[int, int] = {}
        open_ = zstd.ZstdDecompressor()
        for batch in batches:
            for c, d, n in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                totals[c] = totals.get(c, 0) + np.frombuffer(open_.decompress(d), np.int32).astype(np.int64)
                ns[c] = ns.get(c, 0) + n
        keys = sorted(totals)
        logs = [np.round(np.log2(1.0 + totals[k]) * 1024).astype(np.uint16).tobytes() for k in keys]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(logs, pa.binary()), pa.array([ns[k] for k in keys], pa.int64())], names=["chunk", "data", "n"])

    kind = "chunk int, data binary, n long"
    rows = docs.select("text").mapInArrow(count, kind).repartition("chunk").mapInArrow(add, kind).collect()
    out = np.zeros(DF_ROWS << bits, np.uint16)
    for r in rows:
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.data, np.uint16)
    return out.reshape(DF_ROWS, -1), sum(r.n for r in rows)


def gamma_quantiles(n: int) -> np.ndarray:
    """The middles of n equal parts of the distribution Gamma(2, 1), by bisection of 1 - (1 + x) exp(-x)."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 64.0)
    for _ in range(60):
        x = (low + high) / 2
        under = 1 - (1 + x) * np.exp(-x) < p
        low, high = np.where(under, x, low), np.where(under, high, x)
    return (low + high) / 2


class Weights:
    """Inverse document frequencies, and the sampling's random variables."""

    def __init__(self, logs: np.ndarray, n: int):
        self.logs, self.n = np.atleast_2d(logs), n
        self._tables = None

    def __getstate__(self):
        return {"logs": self.logs, "n": self.n, "_tables": None}

    def of(self, h: np.ndarray) -> np.ndarray:
        """1 + ln((1 + N) / (1 + df)) / ln(2 + N) of each shingle."""
        bits = self.logs.shape[1].bit_length() - 1
        least = np.minimum.reduce([self.logs[row][cells(h, row, bits)] for row in range(len(self.logs))])
        scale = 1 / np.log(2.0 + self.n)
        return np.maximum(np.float32(1), np.float32(1 + np.log1p(self.n) * scale) - least * np.float32(np.log(2) / 1024 * scale))

    def tables(self) -> tuple[np.ndarray, ...]:
        if self._tables is None:
            rng = np.random.Generator(np.random.PCG64(SEED))
            r = gamma_quantiles(1 << 16)
            uniform = (np.arange(1 << 16) + 0.5) / (1 << 16)
            self._tables = (r.astype(np.float32), np.log(r).astype(np.float32), uniform.astype(np.float32), rng.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1))
        return self._tables

    def bands(self, h: np.ndarray, weight: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Band keys (a row for each document) of documents whose features lie one after the other, each with one at least."""
        r_, c_, b_, mix = self.tables()
        starts = np.cumsum(sizes) - sizes
        log_w = np.log(weight.astype(np.float32))
        keys = np.empty((BANDS, len(sizes)), np.uint64)
        for band in range(BANDS):
            key = np.full(len(sizes), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                z = h * mix[k]
                z ^= z >> np.uint64(29)
                part = z.view(np.uint16).reshape(-1, 4)  # three of the four are a variable each
                r, beta = r_[part[:, 3]], b_[part[:, 1]]
                t = np.floor(log_w / r + beta)
                a = c_[part[:, 2]] - r * (t - beta) - r
                least = np.minimum.reduceat(a, starts)
                hit = np.nonzero(a == np.repeat(least, sizes))[0]
                # of equal ones the first: hashes are sorted inside a document
                first = hit[np.searchsorted(hit, starts)]
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[first] + mixed(t[first].astype(np.int64).view(np.uint64)))
            keys[band] = key
        return keys.T.view(np.int64)


def signatures(docs: DataFrame, weights: Weights) -> DataFrame:
    """d, x (as given), v (digest of the words; null without words) and the band keys of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches, "text", 1_000_000):
            texts = batch.column(2).to_pylist()
            digest: list[bytes | None] = [None] * len(texts)
            rows, parts = [], []
            for i, t in enumerate(texts):
                w = words(t)
                if w:
                    digest[i] = hashlib.md5(" ".join(w).encode("utf-8", "surrogatepass")).digest()
                    rows.append(i)
                    parts.append(shingles(w, hashes))
            bands: list[list[int] | None] = [None] * len(texts)
            if parts:
                h = np.concatenate([p[0] for p in parts])
                sizes = np.array([len(p[0]) for p in parts])
                keys = weights.bands(h, weights.of(h) * np.concatenate([p[1] for p in parts]), sizes)
                for i, k in zip(rows, keys.tolist(), strict=True):
                    bands[i] = k
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["d", "x", "v", "bands"])

    return docs.select("d", "x", "text").mapInArrow(run, "d long, x long, v binary, bands array<long>")


class Features:
    """Sorted ids of (shingle, n-th occurrence) with their weights: the sum over shared ids is the sum of minima."""

    def __init__(self, text: str, weights: Weights, hashes: WordHashes):
        h, n = shingles(words(text), hashes)
        w = weights.of(h).astype(np.float64)
        ids, all_w = [h], [w]
        level = 1
        while (more := n > level).any():
            ids.append(mixed(h[more] + np.uint64(level * 0xA0761D6478BD642F % (1 << 64))))
            all_w.append(w[more])
            level += 1
            h, n, w = h[more], n[more], w[more]
        ids_, weight = np.concatenate(ids), np.concatenate(all_w)
        order = np.argsort(ids_, kind="stable")
        self.ids, self.weight = ids_[order], weight[order]
        self.total = float(self.weight.sum())

    def similarity(self, other: Features, least: float = 0.0) -> float:
        """Weighted Jaccard similarity; 0 where the totals alone rule ``least`` out."""
        small, large = (self, other) if len(self.ids) <= len(other.ids) else (other, self)
        if min(self.total, other.total) < least * max(self.total, other.total) - 1e-9 or not len(small.ids):
            return 0.0
        at = np.minimum(np.searchsorted(large.ids, small.ids), len(large.ids) - 1)
        shared = float(small.weight[large.ids[at] == small.ids].sum())
        return shared / (self.total + other.total - shared)


def verify(pairs: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of digests those whose texts are similar enough."""
    named = pairs.join(texts.select(F.col("v").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("v").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        known: dict[bytes, Features] = {}
        sum_known = 0
        for batch in slices(batches, "text_b", 2_000_000):
            links = []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sum_known > KNOWN_FEATURES:
                    known.clear()
                    sum_known = 0
                for v, t in ((a, ta), (b, tb)):
                    if v not in known:
                        known[v] = Features(t, weights, hashes)
                        sum_known += len(known[v].ids)
                if known[a].similarity(known[b], similarity) >= similarity:
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in range(2)], names=["a", "b"])

    return named.mapInArrow(run, "a binary, b binary")


class Block:
    """Members of a group, indexed by feature, and the components that the links found so far make of them."""

    def __init__(self) -> None:
        self.members: list[tuple[bytes, bytes]] = []
        self.features: list[Features] = []
        self.parent: dict[bytes, bytes] = {}
        self.index: tuple[np.ndarray, ...] | None = None

    def add(self, v: bytes, root: bytes, features: Features) -> None:
        self.members.append((v, root))
        self.features.append(features)

    def find(self, x: bytes) -> bytes:
        while self.parent.setdefault(x, x) != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def similarities(self, features: Features) -> np.ndarray:
        """Weighted Jaccard similarity with each member."""
        if self.index is None:
            ids = np.concatenate([f.ids for f in self.features])
            order = np.argsort(ids, kind="stable")
            owner = np.repeat(np.arange(len(self.features), dtype=np.int32), [len(f.ids) for f in self.features])
            self.index = ids[order], owner[order], np.array([f.total for f in self.features])
            self.features = []
        ids, owner, total = self.index
        begin = np.searchsorted(ids, features.ids, "left")
        n = np.searchsorted(ids, features.ids, "right") - begin
        shared, done, places = np.zeros(len(total)), 0, np.cumsum(n)
        while done < len(n):  # so many features at a time that their places in the index fit into memory
            upto = max(done + 1, int(np.searchsorted(places, (places[done - 1] if done else 0) + PLACES, "right")))
            some = n[done:upto]
            at = np.repeat(begin[done:upto] - (np.cumsum(some) - some), some) + np.arange(some.sum())
            shared += np.bincount(owner[at], np.repeat(features.weight[done:upto], some), len(total))
            done = upto
        return shared / (features.total + total - shared)

    def links(self, v: bytes, root: bytes, features: Features, least: float) -> list[tuple[bytes, bytes]]:
        """Links of an outsider; of those between two components one."""
        out = []
        if self.members:
            for i in np.nonzero(self.similarities(features) >= least)[0].tolist():
                u, top = self.members[i]
                if self.find(root) != self.find(top):
                    out.append((v, u))
                    self.parent[self.find(root)] = self.find(top)
        return out


def verify_blocks(members: DataFrame, texts: DataFrame, weights: Weights, similarity: float) -> DataFrame:
    """Links between the outsiders and all members of large groups: ``members`` has key (the group), v, root, outside.

    A task compares a block of outsiders with a block of members; of the links between two components it
    returns one.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("mb"), F.ceil(F.count_if("outside") / BLOCK).cast("int").alias("ob"))
    sized = members.join(sizes, "key")
    own = lambda n: F.pmod(F.xxhash64("v", "key"), F.col(n)).cast("int")
    left = sized.where("outside").select("key", "v", "root", F.lit(True).alias("left"), own("ob").alias("o"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"))
    right = sized.select("key", "v", "root", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("o"), own("mb").alias("m"))
    groups = sizes.agg(F.sum(F.col("mb") * F.col("ob"))).first()[0] or 0
    parts = max(1, min(MAX_PARTS, -(-groups // GROUPS_TO_TASK)))
    # members come before outsiders, which are compared one by one as they come
    dealt = left.unionByName(right).join(texts.select("v", "text"), "v").select("key", "o", "m", "left", "v", "root", "text").repartition(parts, "key", "o", "m").sortWithinPartitions("key", "o", "m", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        now, block = None, Block()
        for batch in slices(batches, "text", 2_000_000):
            links: list[tuple[bytes, bytes]] = []
            for key, o, m, is_left, v, root, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, o, m) != now:
                    now, block = (key, o, m), Block()
                features = Features(text, weights, hashes)
                if is_left:
                    links.extend(block.links(v, root, features, similarity))
                else:
                    block.add(v, root, features)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.binary()) for i in range(2)], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary")


def classes(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, x (a hash of the text), v (digest of its words), class_id (the smallest doc_id of the class) and first (the row is that document).

    A class holds documents that are linked by pairs of at least that similarity, over any number of steps.  Texts
    without words are in no class with others.  Rows with the same id and text are one document given twice; a null id comes
    before all others and as class_id stays null.  Other columns are ignored.  An empty table gives no rows.
    """
    tune(docs.sparkSession)
    base = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(text).alias("x"), F.col(text).alias("text"))
    weights = Weights(*document_frequencies(base, sketch_bits(docs.count())))
    signed = stored(signatures(base, weights))
    nodes = signed.where("v is not null").groupBy("v").agg(F.min(F.struct("d", "x")).alias("at"), F.first("bands").alias("bands"))
    keyed = nodes.select("v", "at", F.explode("bands").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"))
    member = stored(keyed.join(shared, "key"))
    wanted = member.select("v", "at").distinct()
    place = F.pmod(F.xxhash64("d", "x"), F.lit(SLOTS))
    slots = wanted.select(F.pmod(F.xxhash64("at.d", "at.x"), F.lit(SLOTS)).alias("slot")).distinct()
    opened = base.join(F.broadcast(slots), place == F.col("slot"), "left_semi")
    texts = stored(opened.join(wanted.select("v", "at.d", "at.x"), ["d", "x"]).select("v", "text").dropDuplicates(["v"]))

    central = member.groupBy("v").agg(F.sum("n").alias("central"))
    ranked = member.join(central, "v")
    # three hubs: the member that shares most buckets, and two at random
    top = ranked.groupBy("key").agg(F.array(F.max_by("v", F.struct("central", "v")), F.max_by("v", F.xxhash64("v")), F.min_by("v", F.xxhash64("v"))).alias("hubs"))
    spokes = member.join(top, "key").select("v", F.explode(F.array_distinct("hubs")).alias("hub")).where("v <> hub")
    first_pairs = spokes.select(F.least("v", "hub").alias("a"), F.greatest("v", "hub").alias("b")).distinct()
    links = stored(verify(first_pairs, texts, weights, similarity))
    roots = components(links)

    placed = member.join(roots, "v", "left").select("key", "n", "v", F.coalesce("root", "v").alias("root"))
    counted = placed.groupBy("key", "root").agg(F.count("*").alias("c"))
    main = counted.groupBy("key").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    mixed_ = stored(placed.join(main, "key").select("key", "n", "v", "root", "main", (F.col("root") != F.col("main")).alias("outside")))
    few = mixed_.where(F.col("n") <= SMALL)
    a, b = few.alias("a"), few.alias("b")
    across = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.v") < F.col("b.v")) & (F.col("a.root") != F.col("b.root"))).select(F.col("a.v").alias("a"), F.col("b.v").alias("b")).distinct().join(first_pairs, ["a", "b"], "left_anti")
    # the large buckets of one main component hold much the same documents: each is dealt out once for all of them
    large = mixed_.where(F.col("n") > SMALL).select(F.col("main").alias("key"), "v", "root", "outside").distinct()
    more = stored(verify(across, texts, weights, similarity).unionByName(verify_blocks(large, texts, weights, similarity)))
    # the links found late are between components: only these are joined further, not all links again
    ends = more
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("v").alias(end), "root"), end, "left").withColumn(end, F.coalesce("root", end)).drop("root")
    merged = components(ends).select(F.col("v").alias("root"), F.col("root").alias("top"))

    node_class = nodes.select("v", "at").join(roots, "v", "left").select("v", "at", F.coalesce("root", "v").alias("root")).join(merged, "root", "left").select("v", "at", F.coalesce("top", "root").alias("root"))
    heads = node_class.groupBy("root").agg(F.min("at").alias("head"))
    of_node = node_class.join(heads, "root").select("v", "head")
    out = signed.select("d", "x", "v").join(of_node, "v", "left").withColumn("head", F.coalesce("head", F.struct("d", "x")))
    plain = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return out.select(plain("d").alias("doc_id"), "x", "v", plain("head.d").alias("class_id"), (F.col("head") == F.struct("d", "x")).alias("first"))


def dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The first document of each class, all columns kept; of rows with the same id and text one (any).

    Nulls, empty texts, ties and empty tables as in ``classes``; columns of any name may be there but __d and __x.
    """
    stays = stored(classes(docs, doc_id=doc_id, text=text, similarity=similarity).where("first").select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__d"), F.col("x").alias("__x")).distinct())
    keyed = docs.withColumns({"__d": F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))), "__x": F.xxhash64(text)})
    kept = keyed.join(stays, ["__d", "__x"], "left_semi")
    return kept.dropDuplicates(["__d", "__x"]).select(*docs.columns)
