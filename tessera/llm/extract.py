"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page becomes a flat list of text blocks; block-level tags end a block, inline tags don't.  A block is
described by its word count and link density, those of the blocks before and after it, whether it is a heading
or a list item, and where it lies: in an article, and in an element that its tag, role or class marks as menu,
advert, notice, comment and the like.  A mark is no verdict.  With it go the share of the page's words that the
marked element holds, whether an article lies inside it, and whether the page has another article; a form or a
``has-sidebar`` wrapper around everything therefore looks unlike an advert.  A CART tree, trained on the blocks of the small
labelled pages below, decides which blocks are text.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import slices, tune

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
#: Elements without text for readers.
SKIPPED = frozenset("head script style noscript template svg math iframe object canvas select textarea button datalist audio video map applet title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ITEMS = frozenset("li dt dd option".split())
CONTENT_TAGS = frozenset("article main".split())
MARKED_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Elements whose classes describe the whole page.
WHOLE = frozenset("html body".split())
#: Landmark roles outside the main text (fixed values).
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tooltip".split())
#: Parts of class and id names that mark an element (fixed values, in lower case).
MARKED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe subscription signup login search form comment comments commentlist disqus respond reply replies discussion pagination pager tags copyright "
    "contentinfo complementary skip toolbar tooltip hidden".split()
)
#: Parts that make a class name say how something looks or behaves, not what it is (fixed values).
STATE_WORDS = frozenset("has no non not with without is was are can js open opened closed collapsed expanded enabled disabled active inactive visible layout free aware hide show".split())
CONTENT_WORDS = frozenset("article content main post story entry body articlebody maincontent postcontent".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
#: An attribute: its whole name, and its value if it has one.
_ATTR = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLING = re.compile("class|id|role|hidden", re.I)
_PART = re.compile("[^a-z0-9]+")


@dataclass
class Mark:
    """An element that its tag (2) or class (1) marks, and the words of the page before its begin and its end."""

    level: int
    begin: int
    end: int = -1
    own_article: int = 0  # words of articles inside it, or in no mark
    depth: int = 0  # of the element in the stack


@dataclass
class TextBlock:
    text: str
    words: int
    link_words: int
    heading: bool
    item: bool
    content: int  # 2 in an article or main element, 1 in one whose class says so
    mark: Mark | None  # the nearest marked element around it
    nested: bool  # an article lies between that element and the block

    @property
    def link_density(self) -> float:
        return self.link_words / self.words if self.words else 0.0


def attributes(raw: str) -> dict[str, str]:
    """The attributes by lower-case name; of repeated ones the first counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(raw):
        value = m[2] or ""
        found.setdefault(m[1].lower(), value[1:-1] if value[:1] in ("'", '"') else value)
    return found


def names(value: str) -> set[str]:
    """What the class names of an attribute name: whole names and their parts, but nothing of names that tell a state."""
    found: set[str] = set()
    for name in value.lower().split():
        parts = [p for p in _PART.split(name) if p]
        if not STATE_WORDS.intersection(parts):
            found.update(parts)
    return found


def kind_of(tag: str, raw: str, in_article: bool) -> tuple[int, int]:
    """(mark, content) of an element: 2 by tag or role, 1 by class or id, 0 not."""
    said: set[str] = set()
    role, hidden = "", False
    if raw and tag not in WHOLE and _TELLING.search(raw):
        a = attributes(raw)
        said = names(a.get("class", "") + " " + a.get("id", ""))
        role, hidden = a.get("role", "").strip().lower(), "hidden" in a
    if tag == "header" and in_article:
        mark = 0  # an article's own heading
    else:
        mark = 2 if hidden or tag in MARKED_TAGS or role in MARKED_ROLES else 0
    mark = mark or int(bool(said & MARKED_WORDS))
    return mark, 2 if tag in CONTENT_TAGS or role in ("main", "article") else int(bool(not mark and said & CONTENT_WORDS))


@dataclass
class _Open:
    """An open element that isn't inline, and what holds inside it."""

    tag: str
    content: int = 0
    mark: Mark | None = None
    nested: bool = False
    own: bool = False  # the mark is its own


def blocks(page: str) -> list[TextBlock]:
    """The text blocks of a page in order; a broken page is read as far as it goes."""
    out: list[TextBlock] = []
    stack: list[_Open] = []
    is_open: Counter[str] = Counter()
    root = _Open("")
    parts: list[str] = []
    link, link_depth = 0, 0
    link_parts: list[str] = []
    skip = ""
    depth = 0
    total = 0

    def flush() -> None:
        nonlocal parts, link_parts, total
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                n = len(text.split(" "))
                tags = [e.tag for e in stack[-3:]]
                at = stack[-1] if stack else root
                out.append(TextBlock(text, n, min(n, len("".join(link_parts).split())), any(t in HEADINGS for t in tags), any(t in ITEMS for t in tags), at.content, at.mark, at.nested))
                total += n
        parts, link_parts = [], []

    def close(keep: int) -> None:
        """Close all elements but the first ``keep``."""
        nonlocal link
        for e in stack[keep:]:
            is_open[e.tag] -= 1
            if e.own:
                e.mark.end = total
        del stack[keep:]
        if link and len(stack) < link_depth:
            link = 0  # a link that nobody closed

    def say(raw: str) -> None:
        if raw:
            text = _html.unescape(raw)
            parts.append(text)
            if link:
                link_parts.append(text + " ")

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            if not skip:
                say(page[at:])
            break
        if not skip and m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = bool(m[1])
        if skip:
            if tag == skip:
                depth += -1 if closing else 1
                if depth == 0:
                    skip = ""
            elif tag == "body":  # a head that nobody closed
                skip = ""
            continue
        if tag in SKIPPED:
            if closing:
                continue
            if tag not in INLINE:
                flush()
            if tag in RAW:
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else size
            elif not m[3].rstrip().endswith("/"):
                skip, depth = tag, 1
            continue
        if tag == "a":
            link, link_depth = (0, 0) if closing else (1, len(stack))
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in INLINE:
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if is_open[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                close(i)
        else:
            if tag in ("p", "li", "dt", "dd", "tr", "td", "th", *HEADINGS):  # these end an open one of their kind
                for i in range(len(stack) - 1, max(-1, len(stack) - 4), -1):
                    if stack[i].tag == tag or (tag in HEADINGS or tag == "p") and stack[i].tag in ("p", *HEADINGS):
                        close(i)
                        break
                    if stack[i].tag not in ("p", "b"):
                        break
            if not m[3].rstrip().endswith("/"):
                around = stack[-1] if stack else root
                mark, content = kind_of(tag, m[3], around.content == 2)
                new = _Open(tag, max(content, around.content), around.mark, around.nested)
                if mark:
                    new.mark, new.nested, new.own = Mark(mark, total), False, True
                elif content and around.mark:
                    new.nested = True
                stack.append(new)
                is_open[tag] += 1
    flush()
    close(0)
    return out


COLUMNS = ["words", "links", "words before", "links before", "words after", "links after", "heading", "item", "content", "mark", "share", "nested", "rival"]


def features(found: list[TextBlock]) -> np.ndarray:
    """A row of ``COLUMNS`` for each block.

    share is that of the page's words in the marked element around the block, and rival tells that an article
    lies outside that element.
    """
    n = len(found)
    own = np.array([(b.words, b.link_density) for b in found], float).reshape(n, 2)
    none = np.zeros((1, 2))
    before, after = np.concatenate((none, own[:-1])), np.concatenate((own[1:], none))
    counts = np.array([b.words for b in found], np.int64)
    ends = np.concatenate(([0], np.cumsum(counts)))
    article = np.concatenate(([0], np.cumsum([b.words if b.content == 2 and (b.mark is None or b.nested) else 0 for b in found])))
    rest = np.zeros((n, 7))
    for i, b in enumerate(found):
        share = nested = rival = 0.0
        if b.mark:
            m = b.mark
            lo, hi = np.searchsorted(ends, (m.begin, m.end))
            share = (m.end - m.begin) / ends[-1]
            nested = float(b.nested)
            rival = float(article[-1] - (article[hi] - article[lo]) > 0)
        rest[i] = (b.heading, b.item, b.content, b.mark.level if b.mark else 0, share, nested, rival)
    return np.hstack((own, before, after, rest))


#: Labelled pages.  A number stands for a block of so many words, + is main text and - is not; after / comes how
#: many of the words are links.
SHAPES = """
<body><nav><ul><li>-1/1<li>-1/1<li>-2/2<li>-1/1</ul></nav><div class="ad">-7</div><article><h1>+12</h1><p>+80<p>+30<p>+55</p></article><footer>-14</footer></body>
<body><nav><ul><li>-1/1<li>-2/2</ul></nav><div class="ad">-9</div><article><h1>+3</h1><p>+2</p></article><footer>-20</footer></body>
<body><nav><ul><li>-1/1<li>-1/1</ul></nav><div class="ad">-12</div><article><h1>+9</h1><p>+4<p>+1<p>+300</article><footer>-9</footer></body>
<body><header><h1>-3</h1><p>-6</header><nav><ul><li>-1/1<li>-3/3</ul></nav><main><h1>+8</h1><p>+60<p>+45<h2>+4</h2><p>+70</main><aside><h3>-2</h3><p>-25<p>-60/4</aside><footer><p>-10/3<p>-12</footer></body>
<body class="x"><div id="header"><a>-2/2</a></div><div id="nav"><ul><li>-1/1<li>-1/1<li>-1/1</ul></div><div id="content"><h2>+7</h2><p>+90<p>+42/3<p>+65</div><div id="footer">-18/2</div></body>
<body><div class="site-header"><h1>-2/2</h1><p>-5</div><div class="post"><h2>+6</h2><p>+40<p>+75/2<p>+12<p>+33</div><div class="sidebar"><h3>-1</h3><ul><li>-3/3<li>-4/4</ul><p>-35</div></body>
<body><div><h1>+6</h1><p>+85<p>+60<p>+25</div></body>
<body><h1>+5</h1><p>+50<p>+7<p>+45</body>
<body><p>+16</body>
<body>+3</body>
<body>+90</body>
<body><h1>+4</h1></body>
<body><ul><li>-1/1<li>-2/2<li>-1/1<li>-1/1</ul><h1>+9</h1><p>+70<p>+80/4<ul><li>-2/2<li>-3/3<li>-2/2</ul><p>-5</body>
<body><ul><li>-2/2<li>-2/2</ul><p>-4<h2>+8</h2><p>+55<ul><li>+14<li>+20<li>+11</ul><p>+40<p>-6/2<p>-3/3</body>
<body><p>-3/2<p>-2/2<p>-3/3<p>+60<p>+35/5<p>+44<p>-2/2<p>-3/2<p>-6</body>
<body><table><tr><td>-2/2<td>-1/1<td>-2/2</table><table><tr><td><p>+95<p>+60<p>+28</table><p>-8/3</body>
<body><div class="wrap"><p>-4/4<p>-2/1<h1>+6</h1><p>+65<p>+18<p>+52<h3>-3</h3><ul><li>-6/6<li>-7/7<li>-5/5</ul></div></body>
<body><form id="aspnet"><ul><li>-1/1<li>-2/2</ul><div><h1>+8</h1><p>+72<p>+55<p>+61</div><p>-9/2</form></body>
<body><form id="aspnet"><article><h1>+5</h1><p>+80<p>+80</article></form></body>
<body><form method="post"><h1>+7</h1><p>+64<p>+90<p>+31</form></body>
<body><form><p>-4<p>-2<p>-6</form><article><h1>+7</h1><p>+64<p>+20</article></body>
<body><article><h1>+7</h1><p>+64<form><p>-12<p>-3</form><p>+40</article></body>
<body><div><h1>+7</h1><p>+64<p>+30<form><p>-16<p>-5</form></div></body>
<body><div class="page sidebar"><h1>+6</h1><p>+75<p>+48<p>+66</div></body>
<body><div class="menu content"><ul><li>-1/1<li>-1/1</ul><p>+80<p>+70<p>+44</div></body>
<body><div class="search results"><article><h2>+6</h2><p>+85<p>+38</article></div></body>
<body><nav><p>-2/2<article><p>+5</p></article></nav></body>
<body><nav><p>-1/1<article><p>+60<p>+20</p></article></nav></body>
<body><header><article><h1>+6</h1><p>+45<p>+70</article></header></body>
<body><div class="header"><p>+85<p>+62</div></body>
<body><div class="notice"><p>+88</div></body>
<body><main class="form"><h1>+5</h1><p>+82<p>+47</main></body>
<body><article class="ad"><p>+84<p>+80</article></body>
<body><article id="social"><h1>+9</h1><p>+50<p>+6<p>+50</article><footer>-11</footer></body>
<body><article><header><h1>+7</h1><p>+4</header><p>+66<p>+24<footer><p>-5/2</footer></article></body>
<body><article><div class="header"><h1>-6</h1></div><p>+66<div class="share"><p>-3/2</div><p>+24<div class="tags">-4/4</div></article></body>
<body><article><h1>+8</h1><p>+70<aside><p>-22</aside><p>+65<aside><p>-40</aside><p>+9</article></body>
<body><article><h1>+8</h1><div class="promo"><p>-15</div><p>+70<div class="newsletter">-18</div><p>+65</article></body>
<body><article><h1>+10</h1><p>+30<ul><li>+9<li>+12<li>+4</ul><p>+25<ol><li>+6<li>+30</ol></article></body>
<body><article><h1>+4</h1><ul><li>-1/1<li>-2/2<li>-2/2</ul><p>+95<p>+62<ul><li>-3/3<li>-4/4</ul></article></body>
<body><article><h1>+6</h1><p>+7/7<p>+90<p>+3/3<p>+48/9<p>+5/4<p>+30</article></body>
<body><article><h1>+6</h1><p>+2<p>+3/3<p>+70<p>+1<p>+4/4<p>+2</article></body>
<body><nav><ul><li>-1/1<li>-2/2</ul></nav><article><h1>+3</h1><p>+2<p>+3/3<p>+1<h2>+1</h2><p>+5/3</article></body>
<body><div class="content"><h1>+6</h1><p>+60/20<p>+45/14<p>+30/9</div></body>
<body><ul><li>-1/1<li>-2/2</ul><h1>+6</h1><p>+70/22<p>+50/17<p>+24/8</body>
<body><article><p>+40<ul><li>+12/4<li>+9/3<li>+15/6<li>+3</ul><p>+3<p>+8</article></body>
<body><article><h1>+7</h1><p>+88<p>+41</article><section class="comments"><h2>-1</h2><article><p>-24<p>-3</article><article><p>-70</article></section></body>
<body><article><h1>+7</h1><p>+30<p>+12</article><section class="comments"><h2>-2</h2><article><p>-124<p>-90</article><article><p>-70<p>-55</article></section></body>
<body><div class="post"><h1>+7</h1><p>+88<p>+41</div><div id="comments"><h3>-2</h3><ul><li class="comment"><p>-30<li class="comment"><p>-62<p>-8</ul></div></body>
<body><article><p>+60<p>+33</article><div class="comments"><div class="content"><p>-33<p>-60</div></div></body>
<body><div class="cookie-notice"><p>-22</div><main><h1>+5</h1><p>+61<p>+58</main><div class="popup"><p>-35</div></body>
<body><div class="cookie"><p>-28</div><h1>+6</h1><p>+52<p>+95<p>+20<div class="copyright">-9</div></body>
<body><div class="banner">-5</div><h1>+6</h1><p>+48<div class="ad">-30</div><p>+60<div class="ad">-6</div><p>+10<p>+45</body>
<body><main><article><h1>+6</h1><p>+50<p>+66</article><aside><article><h3>-6/6</h3><p>-20</article><article><h3>-5/5</h3><p>-24</article></aside></main></body>
<body><main><h1>+4</h1><p>+50<p>+66</main><div class="related"><h3>-2</h3><p>-8/8<p>-30<p>-9/9<p>-28</div></body>
<body><h1>+4</h1><p>+50<p>+66<p>+38<div class="related"><h3>-2</h3><p>-8/8<p>-30</div><div class="widget"><p>-12</div></body>
<body><div hidden><p>-40</div><article><p>+56<p>+3</article></body>
<body><div role="banner"><p>-8</div><div role="main"><h1>+6</h1><p>+45<p>+9</div><div role="contentinfo"><p>-16</div></body>
<body><header><p>-30</header><p>+70<p>+44<footer><p>-45</footer></body>
<body><header><h1>-4</h1><p>-12</header><div class="story"><p>+20<p>+5<p>+35</div><footer><h3>-1</h3><ul><li>-2<li>-4</ul></footer></body>
"""

_NUMBER = re.compile(r"([+-])(\d+)(?:/(\d+))?")


def labelled_page(shape: str) -> str:
    """The page that a line of ``SHAPES`` describes; words of main text are y, others n."""

    def words(m: re.Match) -> str:
        word, n, linked = "y" if m[1] == "+" else "n", int(m[2]), int(m[3] or 0)
        return " ".join([word] * (n - linked)) + (f" <a>{' '.join([word] * linked)}</a>" if linked else "")

    return _NUMBER.sub(words, shape)


def labelled_rows(shapes: list[str]) -> np.ndarray:
    """Features of the blocks of labelled pages, and in the last column the label."""
    found = [blocks(labelled_page(s)) for s in shapes]
    return np.concatenate([np.hstack((features(f), [[float(b.text[0] == "y")] for b in f])) for f in found])


#: The labelled table, a row for each block of the labelled pages.
LABELLED = "\n".join(" ".join(map(repr, row)) for row in labelled_rows(SHAPES.strip().splitlines()).tolist())


@dataclass
class Tree:
    """A CART node: a question and two answers, or a class."""

    label: int
    column: int = -1
    limit: float = 0.0
    low: Tree | None = field(default=None, repr=False)
    high: Tree | None = field(default=None, repr=False)

    def decide(self, x: np.ndarray) -> np.ndarray:
        if self.low is None:
            return np.full(len(x), self.label)
        left = x[:, self.column] <= self.limit
        out = np.empty(len(x), int)
        out[left], out[~left] = self.low.decide(x[left]), self.high.decide(x[~left])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12) -> Tree:
    """The tree with the least Gini impurity at each split."""
    node = Tree(int(y.mean() >= 0.5) if len(y) else 0)
    if depth == 0 or len(set(y.tolist())) < 2:
        return node
    best = (np.inf, -1, 0.0)
    for c in range(x.shape[1]):
        values = np.unique(x[:, c])
        for limit in (values[1:] + values[:-1]) / 2:
            left = y[x[:, c] <= limit]
            right = y[x[:, c] > limit]
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (left, right))
            if impurity < best[0] - 1e-12:
                best = (impurity, c, float(limit))
    if best[1] < 0:  # equal rows with different labels
        return node
    _, node.column, node.limit = best
    left = x[:, node.column] <= node.limit
    node.low, node.high = grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)
    return node


_tree: Tree | None = None


def tree() -> Tree:
    global _tree
    if _tree is None:
        table = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
        _tree = grow(table[:, :-1], table[:, -1].astype(int))
    return _tree


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    keep = tree().decide(features(found))
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per row: page_id, url, text (empty if there is none) and n_chars.

    Null html is an empty page; a null id or URL stays null; whole pages are read, of any length; repeated rows give
    repeated rows, equal pages equal texts (there are no ties to break); other columns are ignored, whatever their
    names; an empty table gives no rows.
    """
    tune(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "h", 4_000_000):
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(page_id).cast("long").alias("p"), F.col(url).cast("string").alias("u"), F.col(html).alias("h")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
