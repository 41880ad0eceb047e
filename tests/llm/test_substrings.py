import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import substrings


def brute(rows, window):
    seen, out = {}, {}
    for d, t in sorted(rows):
        w = substrings.WORD.findall(t or "")
        gone = set()
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone.update(range(i, i + window))
            else:
                seen[k] = True
        kept = [x for i, x in enumerate(w) if i not in gone]
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def corpus(seed):
    r = random.Random(seed)
    passages = [" ".join(r.choice("abcdefgh") * r.randint(1, 2) for _ in range(r.randint(5, 40))) for _ in range(6)]
    rows = []
    for d in range(120):
        parts = [r.choice(passages) if r.random() < 0.6 else " ".join(r.choice("abcdefghij") for _ in range(r.randint(1, 30))) for _ in range(r.randint(0, 5))]
        rows.append((d, r.choice([" ", "\n", " \t"]).join(parts)))
    return rows + [(200, "z " * 400), (201, "z " * 60 + "y"), (202, None), (203, rows[5][1]), (204, "q\x0bq\x0cq q " * 30)]


@pytest.mark.parametrize("options", [{}, {"bucket_bytes": 500}, {"bucket_limit": 200, "bucket_bytes": 2000}])
@pytest.mark.parametrize("window", [5, 20])
def test_removes_what_brute_force_removes(spark, options, window):
    rows = corpus(window)
    got = {r.doc_id: tuple(r)[1:] for r in substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"), window=window, keep_text=False, **options).collect()}
    assert got == brute(rows, window)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=25), max_size=8), st.sampled_from([3, 4, 7]))
def test_partitioning_in_memory(texts, window):
    """The two steps without Spark, two tasks on the way in."""
    import pyarrow as pa

    def arrow(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["d", "t", "text"])

    rows = [(i, 0, " ".join(w)) for i, w in enumerate(texts)]
    sent = [r for part in (rows[1::2], rows[::2]) for b in substrings.split(iter([arrow(part)]), 3, window) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    sent.sort(key=lambda r: r[1])
    gone = {}
    for b in substrings.count(iter([substrings.batch(sent)]), window):
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            gone.setdefault(r[2], set()).update(range(r[4], r[5]))
    want = brute([(d, t) for d, _, t in rows], window)
    assert {d: len(gone.get(d, ())) for d in want} == {d: v[1] for d, v in want.items()}


def test_edges(spark, messy, none):
    got = substrings.dedup(messy).collect()
    assert len(got) == messy.count()
    rows = {r.doc_id: r for r in got}
    assert rows[2].n_words == 0 and rows[2].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[6].n_removed == 0 and rows[7].n_removed == 3000 and rows[7].text == ""
    assert rows[9].text == "more words at the end"[-len(rows[9].text) :] and rows[9].n_removed == 3000
    assert substrings.dedup(none).count() == 0
