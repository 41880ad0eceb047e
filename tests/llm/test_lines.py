import random

import pytest

from tessera.llm import lines


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(r, text, edits):
    s = list(text)
    for _ in range(edits):
        at, kind = r.randrange(len(s)), r.randrange(3)
        if kind == 0:
            s.insert(at, r.choice("abé😀"))
        elif kind == 1 and len(s) > 1:
            del s[at]
        else:
            s[at] = r.choice("abé😀")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_banded_distance(spark, edits):
    r, pairs = random.Random(edits), []
    for _ in range(400):
        a = "".join(r.choice("abé😀") for _ in range(r.randint(edits + 1, 25)))
        pairs.append((a, changed(r, a, r.randint(0, edits + 2))))
    got = lines.within(spark.createDataFrame(pairs, "a string, b string"), "a", "b", edits).collect()
    assert sorted((x.a, x.b) for x in got) == sorted(p for p in pairs if distance(*p) <= edits and p[1])


def brute(rows, edits, least=lines.MIN_CHARS):
    first = {}
    for d, t in sorted(rows):
        for i, line in enumerate((t or "").split("\n")):
            if len(line.strip(" ")) >= least:
                first.setdefault(line, (d, i))
    texts = sorted(first, key=first.get)
    stay = {first[x] for k, x in enumerate(texts) if not any(abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for y in texts[:k])}
    out = {}
    for d, t in rows:
        ls = (t or "").split("\n")
        kept = [x for i, x in enumerate(ls) if len(x.strip(" ")) < least or (d, i) in stay]
        out[d] = (len(ls), len(ls) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize(("edits", "crowd"), [(1, 32), (1, 2), (2, 32)])
def test_removes_what_brute_force_removes(spark, edits, crowd):
    r = random.Random(crowd)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(18, 40))) for _ in range(9)]
    rows = [(d, "\n".join(changed(r, r.choice(base), r.choice([0, 0, 1, 1, 2])) for _ in range(r.randint(1, 80 if d < 2 else 5)))) for d in range(70)]
    rows += [(100, ""), (101, "short\nshort\n\n"), (102, base[0])]
    got = {x.doc_id: (x.n_lines, x.n_removed, x.text) for x in lines.dedup(spark.createDataFrame(rows, "doc_id long, text string"), max_edits=edits, crowd=crowd).collect()}
    assert got == brute(rows, edits)


def test_exact_repeats_of_short_lines(spark):
    import corpus_pipeline

    text = "Les.\n\n  \nLes.\nLes,\na line that is long enough to count"
    docs = spark.createDataFrame([(1, text, 0), (2, "x\nLes.\n\na line that is long enough to count.\nx", 0)], "doc_id long, text string, n_chars long")
    kept = {1: "Les.\n\n  \nLes,\na line that is long enough to count", 2: "x\n"}
    assert {x.doc_id: x.text for x in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()} == kept
    assert {x.doc_id: x.n_removed for x in lines.dedup(docs).collect()} == {1: 0, 2: 1}
    assert {x.doc_id: x.n_removed for x in lines.dedup(docs, short_repeats=True, max_edits=2).collect()} == {1: 1, 2: 3}


def test_plan_has_no_python(spark):
    docs = spark.createDataFrame([(1, "a line that is long enough to count\n" * 3)], "doc_id long, text string")
    assert "Python" not in lines.dedup(docs)._jdf.queryExecution().executedPlan().toString()


def test_edges(spark, messy, none):
    got = lines.dedup(messy)
    assert [c for c in got.columns if c != "n_removed"] == [c for c in messy.columns if c != "n_lines"] + ["n_lines"]
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == messy.count()
    assert rows[2].text is None and rows[3].text == "" and rows[2].n_lines == 1
    assert rows[6].n_removed == 0 and rows[7].n_removed == 1 and rows[7].text == ""
    assert lines.dedup(none).count() == 0
    with pytest.raises(ValueError):
        lines.dedup(messy, max_edits=0)
