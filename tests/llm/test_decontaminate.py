import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate as D
from test_lines import changed
from tests_llm_prose import prose


def least(pattern, text):
    """Least edit distance of the pattern to any substring."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        new = [i]
        for j, y in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=40), st.integers(0, 6))
def test_bit_parallel_distance(pattern, text, k):
    d, got = least(pattern, text), D.best_match(D.masks(pattern), len(pattern), text, k)
    assert (got[0] if got else None) == (d if d <= k and text else None) or (not text and got is None)


def test_finds_what_brute_force_finds(spark):
    r = random.Random(4)
    items = [(i, prose(r, r.randint(10, 40))) for i in range(12)] + [(50, ""), (51, None), (52, "Short one")]
    docs = []
    for d in range(60):
        text = prose(r, r.randint(0, 120))
        if d % 2:
            item = r.choice(items[:12])[1]
            cut = r.randrange(len(text) + 1)
            text = f"{text[:cut]} {changed(r, item, r.choice([0, 1, 5, 12, 40]))} {text[cut:]}"
        docs.append((d, text))
    docs += [(100, None), (101, ""), (102, "a SHORT\n one here")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, item in items:
            p = D.normal(item)
            if p and t and (x := least(p, D.normal(t))) <= D.budget(len(p)):
                want.add((d, i, x))
    for block in (10**6, 400):
        got = {(x.doc_id, x.item_id, x.distance) for x in D.find_leaks(df, bench, block_chars=block).collect()}
        assert got == want
        kept = D.decontaminate(df, bench, block_chars=block)
        assert {x.doc_id for x in kept.collect()} == {d for d, _ in docs} - {d for d, _, _ in want}


def test_edges(spark, messy, none):
    bench = spark.createDataFrame([(1, "a b c", 2), (1, "a b c", 2)], "item_id long, text string, doc_id int")
    got = sorted((x.doc_id or 0) for x in D.find_leaks(messy, bench).collect())
    assert got == [0, 0, 1, 1, 1, 1]
    assert D.find_leaks(none, bench).count() == 0 and D.find_leaks(messy, bench.where("false")).count() == 0
    kept = D.decontaminate(messy, bench)
    assert kept.schema == messy.schema and kept.count() == 8
    assert D.decontaminate(messy, bench.where("false")).count() == 11
