import random
import zlib

from pyspark.sql import functions as F

from tessera.llm import language

STEMS = {"xx": "ba be bi bo bu da de di".split(), "yy": "zor zar zur kor kar kur".split(), "zz": "éli éla élo ñan ñen ñon".split()}


def rows(n, seed):
    r = random.Random(seed)
    return [(" ".join(r.choice(STEMS[lang]) + r.choice(STEMS[lang]) for _ in range(r.randint(3, 60))), lang) for lang in (r.choice(sorted(STEMS)) for _ in range(n))]


def model():
    fit = rows(300, 1)
    return language.train([t for t, _ in fit], [x for _, x in fit])


def test_held_out_accuracy_and_calibration():
    m, held = model(), rows(200, 2)
    got = m.predict([t for t, _ in held])
    assert sum(g[0] == x for g, (_, x) in zip(got, held, strict=True)) >= 195
    assert all(0 <= p <= 1 for _, p in got)
    assert 0 <= m.reject_below <= 1


def test_a_text_scores_alone_as_in_a_batch():
    m = model()
    texts = [t for t, _ in rows(20, 3)] + ["b", "é ñ"]
    together = m.logits(texts)
    for t, row in zip(texts, together, strict=True):
        assert abs(m.logits([t])[0] - row).max() < 1e-9


def test_edges(spark, messy, none):
    m = model()
    got = {r.doc_id: r for r in language.identify(messy, m).collect()}
    assert {d for d, r in got.items() if r.lang_pred == "und"} == {2, 3, 4}
    assert got[2].score == 0 and got[2].rejected and got[8].lang_pred in STEMS
    assert language.identify(messy, m).count() == messy.count() and language.identify(none, m).count() == 0
    assert language.identify(spark.createDataFrame([(1, "123 .. 4!")], "doc_id long, text string"), m).first().lang_pred == "und"
    assert language.train([], []).predict(["abc"]) == [("und", 0.0)]
    assert language.train(["ab ab", "ab"], ["xx", "xx"]).predict(["ab"])[0] == ("xx", 1.0)


def test_sample_leaves_the_held_out_fold_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}", None if i % 7 == 0 else "xx") for i in range(100)], "doc_id long, text string, lang string")
    got = language.sample(docs, "text", "lang", ~(language.remainder("doc_id", 5) == 0), "doc_id")
    assert got == sorted((f"text {i}", "xx") for i in range(100) if i % 7 and zlib.crc32(str(i).encode()) % 5)


def test_sample_learns_every_language(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"lang-{i % 250}") for i in range(500)], "doc_id long, text string, lang string")
    assert {lang for _, lang in language.sample(docs, "text", "lang", F.lit(True), "doc_id")} == {f"lang-{k}" for k in range(250)}


def test_long_texts_in_bounded_memory(monkeypatch):
    """Stretches don't change the result, and a long text under many languages needs no row of logits for each character."""
    import tracemalloc

    import numpy as np

    texts = [t for t, _ in rows(40, 4)] + ["", "..", "b", " ba  be ", "Ñan ÉLO." * 50]
    m = model()
    whole, plain = m.logits(texts), [language.codes(t) for t in texts]
    for part in (1, 7, 64):
        monkeypatch.setattr(language, "PART", part)
        monkeypatch.setattr(language, "CELLS", 0)
        assert all((language.codes(t) == c).all() for t, c in zip(texts, plain, strict=True))
        monkeypatch.setattr(language, "PART", max(part, 1024))
        assert np.abs(m.logits(texts) - whole).max() < 1e-9
    monkeypatch.undo()
    many = language.Model([str(i) for i in range(200)], np.ones((language.BUCKETS, 200), np.float32), np.zeros(200), 1.0, 0.0)
    tracemalloc.start()
    many.predict(["some words of a long text " * 80_000])
    assert tracemalloc.get_traced_memory()[1] < 250e6
