import random
import zlib

import numpy as np

from tessera.llm import toxicity
from tests_llm_prose import prose

INSULTS = ["blockhead", "numskull", "dimwits", "nitwitted"]


def labelled(n, seed=0):
    r, rows = random.Random(seed), []
    for i in range(n):
        w, bad = prose(r, r.randint(20, 200)).split(), i % 3 == 0
        if bad:
            for _ in range(r.randint(3, 8)):
                w.insert(r.randrange(len(w)), r.choice(INSULTS))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_held_out_accuracy():
    rows = labelled(600)
    model = toxicity.train([t for i, t, _ in rows if i % 2], [y for i, _, y in rows if i % 2])
    held = [(t, y) for i, t, y in rows if not i % 2]
    y = np.array([y for _, y in held])
    predicted = model.scores([t for t, _ in held]) >= toxicity.THRESHOLD
    assert predicted[y == 1].mean() > 0.9 and predicted[y == 0].mean() < 0.02


def test_the_primer_makes_one_match_count():
    rows = labelled(300)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    clean = "gammas deltaed the epsilon of zetaing and so on"
    with_one, without = model.features([clean + " blockhead", clean])
    assert with_one[0] >= without[0] + 2


def test_edges(spark, messy, none):
    rows = labelled(90)
    model = toxicity.train([t for _, t, _ in rows], [y for _, _, y in rows])
    got = toxicity.score(messy, model).collect()
    assert len(got) == messy.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    empty = {r.score for r in got if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1
    assert toxicity.score(none, model).count() == 0
    kept = toxicity.keep_clean(messy, model)
    assert kept.schema == messy.schema and kept.count() == sum(r.predicted == 0 for r in got)
    assert toxicity.keep_clean(none, model).count() == 0
    untaught = toxicity.train([], [])
    assert untaught.scores(["blockhead", ""]).max() < 0.01
    assert toxicity.train(["a"], [1]).scores(["a"])[0] < 0.01


def test_only_rows_outside_the_held_out_fold_are_learned_from(spark):
    rows = labelled(60)
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, None), (0, 1), (None, 1)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, toxicity.remainder("doc_id") == 1)
    want = sorted((t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1)
    assert got == want
