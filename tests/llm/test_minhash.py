import random

import numpy as np
import pytest

from tessera.llm import components, minhash
from tests_llm_prose import prose


def near_groups(seed, groups, size, words, cuts):
    """Groups of texts that differ in a few words, and texts of their own."""
    r, rows = random.Random(seed), []
    for _ in range(groups):
        base = prose(r, words).split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, cuts)):
                w[r.randrange(len(w))] = r.choice(["changed", "other", "new"]) + str(r.randint(0, 99))
            rows.append(" ".join(w))
    rows += [prose(r, r.randint(1, 60)) for _ in range(40)] + rows[:5]
    r.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, weights, least=minhash.SIMILARITY):
    hashes, parent = minhash.WordHashes(), {}
    features = {d: minhash.Features(t, weights, hashes) for d, t in rows}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            if features[a].similarity(features[b]) >= least:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {d: find(d) for d, _ in rows}


@pytest.mark.parametrize(("small", "block"), [(24, 192), (2, 4)])
def test_classes_are_those_of_all_pairs(spark, monkeypatch, small, block):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = near_groups(1, 6, 12, 60, 4)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weights = minhash.Weights(*minhash.document_frequencies(docs))
    assert {r.doc_id: r.class_id for r in minhash.classes(docs).collect()} == brute(rows, weights)


def test_sampling_estimates_similarity():
    r = random.Random(3)
    weights = minhash.Weights(np.zeros(1 << minhash.DF_BITS, np.int64), 10)
    hashes = minhash.WordHashes()
    w = prose(r, 400).split()
    other = list(w)
    for i in range(0, 400, 40):
        other[i] = "changed"
    docs = [minhash.shingles(x, hashes) for x in (w, other, w)]
    h, n = np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs])
    keys = weights.bands(h, weights.of(h) * n, np.array([len(d[0]) for d in docs]))
    assert (keys[0] == keys[2]).all()
    same = (keys[0] == keys[1]).mean()
    s = minhash.Features(" ".join(w), weights, hashes).similarity(minhash.Features(" ".join(other), weights, hashes))
    assert 0.7 < s < 0.85 and abs(same - s**3) < 0.45


def test_weighted_similarity_counts_occurrences():
    weights = minhash.Weights(np.zeros(1 << minhash.DF_BITS, np.int64), 10)
    hashes = minhash.WordHashes()
    a, b = (minhash.Features(t, weights, hashes) for t in ("a a a a a a a a", "a a a a a a"))
    assert a.similarity(b) == pytest.approx(2 / 4)
    assert a.similarity(a) == pytest.approx(1)


def test_edges(spark, messy, none):
    got = [(r.doc_id, r.class_id) for r in minhash.classes(messy).collect()]
    assert len(got) == messy.count()
    of = dict(got)
    # a null id comes first, and texts without words stay alone
    assert of[1] is None and of[None] is None
    assert of[2] == 2 and of[3] == 3 and of[4] == 4
    assert of[6] == of[7] == of[9] == 6
    assert minhash.classes(none).count() == 0
    kept = minhash.dedup(messy)
    assert kept.columns == messy.columns
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect()) == [(False, 0), (True, 2), (True, 3), (True, 4), (True, 5), (True, 6), (True, 8)]
    # rows that are equal in id and text: one stays
    assert minhash.dedup(messy.where("doc_id = 1")).count() == 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (101, 100)]
    got = {r.v: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100: 100, 101: 100, 102: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_document_frequencies_against_exact_ones(spark):
    """A small table's frequencies are exact but for rounding, a narrow sketch only errs upwards, by a small share of all documents."""
    from collections import Counter

    r, hashes = random.Random(8), minhash.WordHashes()
    rows = [(i, prose(r, r.randint(0, 80))) for i in range(300)] + [(1000 + i, "the same ten words stand in all of these texts") for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = [minhash.shingles(minhash.words(t), hashes)[0].tolist() for _, t in rows]
    true = Counter(h for f in found for h in f)
    n = sum(1 for f in found if f)
    h = np.array(list(true), np.uint64)
    df = np.array(list(true.values()))
    exact = 1 + np.log((1 + n) / (1 + df)) / np.log(2 + n)
    weights = minhash.Weights(*minhash.document_frequencies(docs))
    assert weights.n == n and np.quantile(np.abs(weights.of(h) - exact), 0.999) < 0.002
    narrow = minhash.Weights(*minhash.document_frequencies(docs, 12))
    read = (1 + n) / np.exp((narrow.of(h) - 1) * np.log(2 + n)) - 1
    assert (read > df - 0.1).all() and np.quantile(read - df, 0.99) < 4 * len(h) / (1 << 12)


def test_the_sketch_grows_with_the_corpus():
    assert [minhash.sketch_bits(n) for n in (0, 2 << 20, (2 << 20) + 1, 8 << 20, 15_000_000, 10**12)] == [20, 20, 21, 21, 22, 24]


def test_recall_of_planted_near_copies(spark):
    """Against brute force with exact TF-IDF: nine of ten and more of the documents that have a partner are found."""
    from collections import Counter

    r = random.Random(12)
    rows = []
    for size in (2, 2, 2, 3, 3, 5, 20):
        base = prose(r, 300).split()
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = prose(r, 1)
            rows.append(" ".join(w))
    rows = list(enumerate(rows + [prose(r, 200) for _ in range(40)]))
    grams = [Counter(zip(*(minhash.words(t)[j:] for j in range(5)), strict=False)) for _, t in rows]
    df = Counter(g for c in grams for g in c)
    weight = {g: 1 + np.log((1 + len(rows)) / (1 + n)) / np.log(2 + len(rows)) for g, n in df.items()}

    def similarity(a, b):
        low = sum(min(a[g], b[g]) * weight[g] for g in a if g in b)
        return low / (sum(n * weight[g] for g, n in a.items()) + sum(n * weight[g] for g, n in b.items()) - low)

    links = [(i, j) for i in range(len(rows)) for j in range(i) if similarity(grams[i], grams[j]) >= minhash.SIMILARITY]
    got = {x.doc_id: x.class_id for x in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(links) > 50
    assert sum(got[i] == got[j] for i, j in links) >= 0.98 * len(links)
    assert all(got[i] == i for i, _ in rows[37:])


def test_features_have_draws_of_their_own():
    """Hardly two of 20 000 features share the three variables of a sample; their distributions are those of the method."""
    weights = minhash.Weights(np.zeros(1 << minhash.DF_BITS, np.int64), 10)
    r, log_r, beta, mix = weights.tables()
    h = np.random.default_rng(1).integers(0, 1 << 63, 20_000, np.uint64) * np.uint64(2)
    z = h * mix[0]
    z ^= z >> np.uint64(29)
    part = z.view(np.uint16).reshape(-1, 4)
    assert len(np.unique(part[:, 1:], axis=0)) == len(h)
    assert r[part[:, 3]].mean() == pytest.approx(2, abs=0.05) and r[part[:, 3]].var() == pytest.approx(2, abs=0.15)
    assert np.exp(log_r[part[:, 2]]).mean() == pytest.approx(2, abs=0.05) and beta[part[:, 1]].mean() == pytest.approx(0.5, abs=0.01)
    assert abs(np.corrcoef(part[:, 1:].astype(float).T) - np.eye(3)).max() < 0.03
