import pytest

from tessera.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News of the day</a></li></ul></nav><!-- <p>not this</p> -->
<div class="ad">Buy one, get <b>two</b> today only.</div><div id="cookie-notice"><p>We use cookies on this site to make it much better for all who visit it.</p></div>
<article><h1>A title &amp; more</h1><p>First   paragraph with <b>bold</b>face and&nbsp;a <a href="x">link</a>.<br>Still the first.<p>Tiny.</p>
<aside>Related things to read that nobody asked for at all.</aside><ul><li>One point made</li><li>Another point made</li></ul><form><input><label>Mail</label></form></article>
<section class="comments"><h2>Comments</h2><article><p>I liked this text so much that I had to write a long comment about it.</p></article></section>
<footer>&copy; somebody &middot; all rights reserved</footer></body></html>"""


def test_article_only():
    assert extract.main_text(PAGE).split("\n") == ["A title & more", "First paragraph with boldface and a link. Still the first.", "Tiny.", "One point made", "Another point made"]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("<p>", ""),
        ("just text", "just text"),
        ("<p>An unmarked page has only this one paragraph, and it is long enough to be a text.</p>", "An unmarked page has only this one paragraph, and it is long enough to be a text."),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("<article><p>cut off &am", "cut off &am"),
        ("<article><p>a &lt;b&gt; &#233; &eacute;</p></article>", "a <b> é é"),
        ("<article><p>x<!-- never closed <p>y", "x"),
        ("<nav><a>unclosed menu</a><article><p>still the text</p></article>", "still the text"),
        ("<article><header><h1>Own heading</h1></header><p>Text.</p></article>", "Own heading\nText."),
    ],
)
def test_pages(page, text):
    assert extract.main_text(page) == text


def test_the_tree_has_learned_its_table():
    import numpy as np

    table = np.array([[float(v) for v in line.split()] for line in extract.LABELLED.strip().splitlines()])
    assert (extract.tree().decide(table[:, :-1]) == table[:, -1]).all()


def test_long_pages_stay_linear():
    import time

    page = "<article>" + "<p>some words in a paragraph of text</p>" * 20_000 + "</article>"
    began = time.time()
    assert extract.main_text(page).count("\n") == 19_999
    assert extract.main_text("<" * 50_000) is not None
    assert time.time() - began < 20


def test_columns(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "w", "", "x")], "page_id long, url string, html string, text string")
    got = extract.extract(pages).collect()
    assert sorted((r.page_id or 0, r.url or "", r.n_chars) for r in got) == sorted([(0, "w", 0), (1, "u", len(extract.main_text(PAGE))), (1, "u", len(extract.main_text(PAGE))), (2, "", 0)])
    assert extract.extract(pages.where("false")).count() == 0


LONG = " ".join(["word"] * 80)


@pytest.mark.parametrize(
    "page",
    [
        '<div style="overflow:hidden"><p>{}</p></div>',
        '<article style="overflow: hidden"><p>{}</p><p>{}</p></article>',
        '<article title="a hidden gem"><p>{}</p></article>',
        '<article data-id="ad"><p>{}</p></article>',
        '<div data-role="menu"><p>{}</p><p>{}</p></div>',
        '<body class="wp has-sidebar"><article><p>{}</p></article>',
        '<body class="menu-open"><div><p>{}</p></div>',
        '<body class="right-sidebar"><p>{}</p><p>{}</p>',
        '<div class="no-sidebar"><p>{}</p></div>',
        '<div class="right-sidebar"><article><p>{}</p></article></div>',
        '<form id="aspnetForm"><article><p>{}</p></article></form>',
        '<form id="aspnetForm"><p>{}</p><p>{}</p></form>',
    ],
)
def test_words_in_attributes_drop_no_article(page):
    assert extract.main_text(page.replace("{}", LONG)) == "\n".join([LONG] * page.count("{}"))


@pytest.mark.parametrize("other", ['<div class="ad"><p>{}</p></div>', "<nav><p>{}</p></nav>", "<footer>{}</footer>", "<aside><p>{}</p></aside>", "<form><p>{}</p></form>", '<div id="cookie-notice">{}</div>', '<section class="comments"><article><p>{}</p></article></section>', "<div hidden>{}</div>", '<div role="navigation">{}</div>'])
def test_what_the_contract_excludes(other):
    for n in (3, 12, 40):
        page = f"<body><article><h1>A title</h1><p>{LONG}</p></article>{other.format(' '.join(['other'] * n))}</body>"
        assert extract.main_text(page) == f"A title\n{LONG}"


def left_out_accuracy(drop=()):
    """Share of blocks classified rightly when their page is left out of the labelled ones."""
    import numpy as np

    shapes = extract.SHAPES.strip().splitlines()
    keep = [i for i, c in enumerate(extract.COLUMNS) if c not in drop]
    right = total = 0
    for i, shape in enumerate(shapes):
        rest, own = extract.labelled_rows(shapes[:i] + shapes[i + 1 :]), extract.labelled_rows([shape])
        found = extract.grow(rest[:, keep], rest[:, -1].astype(int)).decide(own[:, keep])
        right, total = right + int(np.sum(found == own[:, -1])), total + len(own)
    return right / total


def test_words_and_links_decide_and_marks_help():
    whole = left_out_accuracy()
    assert whole > 0.94
    assert left_out_accuracy(("mark", "share", "nested", "rival")) > 0.78  # words and links of the blocks alone
    assert left_out_accuracy(("words", "links", "words before", "links before", "words after", "links after")) < whole - 0.04


def test_marks_alone_are_no_verdict():
    import numpy as np

    table = extract.labelled_rows(extract.SHAPES.strip().splitlines())
    marked = table[table[:, extract.COLUMNS.index("mark")] > 0]
    assert 0.1 < np.mean(marked[:, -1]) < 0.5


def test_a_link_around_a_heading_is_a_link():
    found = extract.blocks('<div><a href="x"><h3>Read this too</h3><p>and this</p></a><p>plain text</p></div><p><a>never closed</p><p>plain again</p>')
    assert [b.link_density for b in found] == [1, 1, 0, 1, 0]


def test_deep_pages_stay_linear():
    import time

    began = time.time()
    assert extract.main_text("<div class='ad'>" * 30_000 + "</section>" * 30_000 + "<p>text here") is not None
    assert time.time() - began < 20


@pytest.mark.parametrize("where", ["check_s", "sf0.01"])
def test_given_pages(where):
    """The pages have one article each: its blocks are the text, to the character."""
    import html
    import re
    from pathlib import Path

    import duckdb

    path = Path(f"/root/testdata/{where}/pages.parquet")
    if not path.exists():
        pytest.skip("no such table here")
    rows = duckdb.sql(f"SELECT html FROM '{path}{'/*.parquet' if path.is_dir() else ''}' ORDER BY page_id % 97, page_id LIMIT 1500").fetchall()
    for (page,) in rows:
        article = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", q))).split()) for q in re.split("</?(?:p|h1)>", article)]
        assert extract.main_text(page) == "\n".join(p for p in parts if p)
