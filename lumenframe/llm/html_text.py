"""Main text of web pages from flat text blocks, classified by a decision tree.

A page is cut at block-level tags into a flat list of text blocks. Each block is described by its word count and
link density, those of its two neighbours, the run of link blocks that it is in, and by what its surrounding tags say
(inside an article, inside a part whose class or id speaks for or against main text, a heading). A decision tree
fitted to the blocks of a few labelled pages tells content from the rest.
"""

from __future__ import annotations

import html
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "run", "aside", "notice", "main", "article", "heading"]

# Labelled pages. +n is a block of n words that is content, -n one that is not, =n are n more words of a block.
LABELLED_PAGES = [
    # articles: long and short paragraphs, headings, linked paragraphs, menus before and after
    "<nav><a>-1</a><p><a>-1</a></nav><article><h1>+8</h1><p>+60<p>+45 <a>=3</a><p>+4<h2>+3</h2><p>+38<p><a>+9</a></article><ul><li><a>-2</a><li><a>-3</a></ul>",
    "<div><a>-1</a></div><div><a>-1</a></div><div><a>-2</a></div><article><h1>+5</h1><p>+6<p><a>+4</a> =2<p>+2<p>+90<ul><li>+3<li>+5<li>+12</ul><p>+1</article><p>-3",
    "<header><h1>-2</h1><p>-7</header><article><header><h1>+9</h1><p>-4</header><p>+20<p>+33<aside><h3>-2</h3><p>-30</aside><p>+7<p class=notice>+5<p class=alert>+25</article><footer>-9</footer>",
    "<ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul><article><p>+3<p>+7<p><a>+3</a><p>+14<p>+2<div class=share><p>-3</div></article><div><a>-1</a></div><div><a>-2</a></div>",
    "<div class=menu><p>-2<p>-4</div><article><p>+11<p><a>+7</a><p>+28<div class=comments><p>-30<p>-6</div></article><div class=notice>-18</div>",
    # pages without an article element, the main part named or not
    "<ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul><div class=content><h1>+6</h1><p>+50<p>+8<p>+44<p>+5<p><a>+8</a><p>+30</div><div class=footer><p>-12</div>",
    "<div><a>-2</a></div><div><a>-1</a></div><div><a>-1</a></div><div><a>-2</a></div><div><h1>+7</h1><p>+48<p>+35 <a>=4</a><p>+9<p>+26<p>+52</div><div><a>-2</a></div><div><a>-1</a></div>",
    "<main><h1>+4</h1><p>+3<p>+70<p>+6<h2>+2</h2><p>+40 <a>=9</a><p>+5</main><ul><li><a>-3</a><li><a>-2</a></ul><p>-3",
    "<div id=nav><p>-3</div><table><tr><td><a>-1</a><td><a>-1</a><td><a>-2</a></table><h1>+9</h1><p>+31<p>+64<p>+12<p>+40<div><a>-4</a></div><div><a>-6</a></div><div><a>-5</a></div><div>-4</div>",
    "<div class=entry><p>+15<p>+4<p>+7<h3>+5</h3><p>+22</div><div class=sidebar><h3>-2</h3><p>-40<p>-3</div><div class=copyright>-6</div>",
    "<p>+40<p>+36<p>+10<p>+45", "<p>+12", "<h1>+4</h1><p>+25<p>+9<p>+18", "<div class=notice>-20</div><h1>+5</h1><p>+34<p>+41<div class=legal>-40</div>",
    "<ul><li><a>-1</a><li><a>-1</a><li><a>-2</a><li>-1</ul><h2>+6</h2><p>+55<p>+30<h2>+3</h2><p>+29<h3>-2</h3><ul><li><a>-5</a><li><a>-7</a><li><a>-6</a></ul>",
    "<ul><li><a>-6</a><li><a>-8</a><li><a>-12</a></ul><div><a>-2</a> -1 <a>=2</a></div><p>+58<p>+16 <a>=5</a><p>+47<p><a>-2</a> =1<p><a>-1</a><p>-3",
    # short blocks of a main part, headlines of other pages, runs of linked paragraphs in an article
    "<main><p>+30<p>+2<p>+1<p>+44<p>+2<p>+1</main><p>-2<p>-4", "<div class=post><p>+2<p>+20<p>+1<p>+2<p>+40<p>+1</div><div><p>-2</div>",
    "<div class=story><p>+1<p>+6<p>+2<p>+3</div>", "<p>-2<p>-1<div class=text><p>+2<p>+2<p>+9</div>",
    "<p>+41<p>+50<p>+38<h3>-3</h3><ul><li><a>-9</a><li><a>-12</a><li><a>-15</a><li><a>-10</a><li><a>-14</a></ul>",
    "<ul><li><a>-11</a><li><a>-16</a><li><a>-9</a><li><a>-13</a></ul><h1>+8</h1><p>+39<p>+33", "<div><a>-20</a></div><div><a>-18</a></div><div><a>-25</a></div><p>+60<p>+52",
    "<article><p>+20<p><a>+9</a><p><a>+12</a><p>+30<p><a>+2</a><p><a>+3</a><p><a>+5</a><p>+4</article>",
    "<article><p><a>+2</a><p><a>+3</a><p><a>+16</a></article><div><a>-3</a></div><div><a>-2</a></div>", "<article><h1>+2</h1><p><a>+1</a> =1<p><a>+6</a><p>+2</article>",
    "<main><p>+24<p><a>+4</a><p><a>+7</a><p>+31</main>", "<div class=notice>-60</div><div class=notice>-8</div><p>+50<p>+20<div class=alert>-31</div>",
    "<article><p>+40<div class=notice>+12</div><p>+9<p class=notice>+3</article>", "<p>+22<p>+31<div><a>-1</a></div><div><a>-2</a></div><div>-2</div><div><a>-1</a></div>",
    "<div class=post><p>+30<p>+26<div class=notice>-9</div></div>", "<div class=story><div class=alert>-22</div><p>+40<p>+8<p class=legal>-35</div>",
    # menus inside a part that is named like main text
    "<div class=main><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul><h1>+5</h1><p>+30<p>+41</div>", "<div id=content><div><a>-1</a></div><div><a>-3</a></div><div><a>-2</a></div><p>+22<p>+9<p>+37<ul><li><a>-4</a><li><a>-9</a><li><a>-12</a></ul></div>",
    # pages that name nothing but what stands around the text
    "<header><h1>-4</h1><p>-15</header><h1>+6</h1><p>+30<p>+8<p>+41<footer><p>-20<p>-3</footer>", "<aside><p>-28<p>-12</aside><h2>+8</h2><p>+19<p>+26<p>+9<p>+14<div class=related><h3>-3</h3><p>-22<p>-45</div>",
    "<div class=cookie><p>-30</div><h1>+5</h1><p>+12<p>+28<p>+7<p>+60<div class=comments><p>-25<p>-60<p>-8<p>-14<p>-34<p>-19</div>", "<div class=ad>-15</div><h1>+7</h1><p>+80<p>+10<div class=ad>-9</div><p>+20<p>+16<form>-24</form>",
    "<nav><p>-1<p>-6</nav><div class=promo><h2>-5</h2><p>-23<p>-37</div><h1>+9</h1><p>+13<p>+8<h2>+4</h2><p>+8<p>+20<h2>+5</h2><p>+11<footer><p>-9<p>-16</footer>",
    "<dialog><p>-14<p>-26</dialog><h1>+4</h1><p>+8<p>+12<p>+8<ul><li><a>-2</a><li><a>-3</a><li><a>-2</a></ul>", "<div class=sidebar><p>-50<p>-17<p>-33</div><h1>+10</h1><p>+9<p>+18<div class=widget><p>-21<p>-70</div>",
    "<div><a>-1</a></div><div><a>-2</a></div><h1>+8</h1><p>+12<p>+45<p>+8<div><a>-1</a></div><div><a>-2</a></div>", "<ul><li><a>-1</a><li><a>-1</a></ul><h1>+4</h1><p>+20<p>+8<h2>+7</h2><p>+80<p>+12<div><a>-2</a></div><div><a>-1</a></div>",
    "<ul><li><a>-2</a><li><a>-1</a><li><a>-1</a></ul><h1>+6</h1><p>+8<p>+12", "<table><tr><td><a>-1</a><td><a>-2</a></table><h1>+9</h1><p>+80<p>+45<p>+12", "<div><a>-1</a></div><div><a>-1</a></div><h1>+5</h1><p>+45<p>+12<p>+20<p>+8",
]


@dataclass
class Node:
    content: bool
    feature: int = -1
    limit: float = 0.0
    low: Node | None = None
    high: Node | None = None


def fit_tree(rows: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> Node:
    """A binary decision tree: each split takes the feature and limit with the least weighted Gini impurity.

    Ties go to the first feature and the smallest limit; an even leaf is content.
    """
    leaf = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or len(set(y.tolist())) < 2:
        return leaf
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= limit
            if min(low.sum(), (~low).sum()) < least:
                continue
            gini = sum(len(p) * 2 * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(limit), low)
    if best is None or best[0] >= len(y) * 2 * y.mean() * (1 - y.mean()) - 1e-12:
        return leaf
    _, f, limit, low = best
    return Node(leaf.content, f, limit, fit_tree(rows[low], y[low], depth - 1, least), fit_tree(rows[~low], y[~low], depth - 1, least))


def labelled_table() -> np.ndarray:
    """The features of each block of the labelled pages, then 1 for content."""
    word = {"+": "content", "-": "rest", "=": "more"}
    out = []
    for page in LABELLED_PAGES:
        found = blocks(re.sub(r"([-+=])([0-9]+)", lambda m: " ".join([word[m[1]]] + ["word"] * (int(m[2]) - 1)), page))
        out += [[*row, text.startswith("content")] for (text, *_), row in zip(found, features(found), strict=True)]
    return np.array(out, float)


def trained_tree() -> Node:
    table = labelled_table()
    return fit_tree(table[:, :-1], table[:, -1])


def classify(node: Node, features: list[float]) -> bool:
    while node.feature >= 0:
        node = node.low if features[node.feature] <= node.limit else node.high
    return node.content


_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_NAMED = re.compile(r"""(?:^|(?<=[\s"'/]))(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|\baria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# Elements whose text is no text of the page, that end a text block, and that hold others.
RAW = set("script style noscript template svg math canvas iframe object textarea select head title".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i img ins del input kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br nobr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ASIDE_TAGS = set("nav footer aside dialog menu button fieldset".split())
TELLING = ASIDE_TAGS | {"article", "main", "form", "header"}
ASIDE_ROLES = set("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
# Words of a class or id. Readers' comments, adverts and links to other pages are never main text; parts of the layout may
# hold the article; notices are main text inside an article only; the last speak for the main text.
APART_WORDS = set("""
ad ads advert adverts advertisement advertising sponsor sponsored promo promotion newsletter subscribe signup social share sharing related
recommended comment comments commentlist disqus respond reply replies
""".split())
LAYOUT_WORDS = set("""
sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr banner popup modal overlay login search widget
widgets skip pagination pager toolbar copyright
""".split())
NOTICE_WORDS = set("notice notices alert legal".split())
MAIN_WORDS = set("article content entry main post story text".split())
# Words that turn the others of a name into a state of the page (has-sidebar), and those of a frame around several parts.
STATE_WORDS = set("has with without layout".split())
FRAME_WORDS = set("wrap wrapper container inner outer".split())
#: Elements that end an open one of the same kind, and those beyond which they do not look for it.
ENDS_ITSELF = {"p": set(), "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_PARTS = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


@dataclass(slots=True)
class Open:
    """An element that is open. apart: it and what it holds is no main text; layout: a part of the layout by its tag, class or
    id, which the outermost article or main element inside overrules; inside: in such an element; notice, main: by class or
    id, or in such an element; header: only headings of it count."""

    tag: str
    apart: bool = False
    layout: bool = False
    notice: bool = False
    main: bool = False
    article: bool = False
    inside: bool = False
    header: bool = False

    @property
    def aside(self) -> bool:
        return self.apart or self.layout


def _opened(tag: str, attributes: str, outer: Open) -> Open:
    o = Open(tag, outer.apart, outer.layout, outer.notice, outer.main, outer.article, outer.inside, outer.header)
    if not attributes and tag not in TELLING:
        return o
    if tag in ("article", "main"):
        o.layout, o.inside = o.layout and o.inside, True
    o.apart |= tag in ASIDE_TAGS
    o.layout |= tag == "form"
    o.article |= tag == "article"
    o.main |= tag in ("article", "main")
    header = tag == "header"
    for m in _NAMED.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            roles = set(value.lower().split())
            o.apart |= bool(roles & ASIDE_ROLES)
            o.article |= "article" in roles
            o.main |= bool(roles & {"main", "article"})
        elif tag not in ("body", "html"):
            for name in value.split():
                parts = set(_PARTS.split(_CAMEL.sub("-", name).lower()))
                if parts & STATE_WORDS:
                    continue
                o.apart |= bool(parts & APART_WORDS)
                if parts & LAYOUT_WORDS:
                    frame = "no" in parts or ("content" in parts and parts & FRAME_WORDS)
                    o.layout |= not frame and tag not in ("article", "main")
                elif not parts & APART_WORDS:
                    o.notice |= bool(parts & NOTICE_WORDS)
                    o.main |= bool(parts & MAIN_WORDS) and not parts & FRAME_WORDS
                header |= ("header" in parts or "masthead" in parts) and not parts & FRAME_WORDS and tag not in ("article", "main")
    if header:
        o.header, o.apart = True, o.apart or not o.inside
    o.apart |= bool(_HIDDEN.search(attributes))
    return o


Block = tuple[str, float, bool, bool, bool, bool, bool]


def blocks(page: str) -> list[Block]:
    """(text, share of its words in links, aside, notice, main, in an article, heading) of each block with text, in page order.

    Every element but the void ones is on the stack while it is open; a closing tag closes what is open inside, an inline one
    only itself. An inline element that is set apart does not end the block that it is in; its text is a block of its own.
    """
    out: list[Block] = []
    stack = [Open("")]
    texts: list[str] = []
    linked: list[str] = []
    apart: list[str] = []

    def cleaned(parts: list[str]) -> str:
        return " ".join(html.unescape("".join(parts)).split())

    def close_block() -> None:
        if not texts and not apart:
            return
        if text := cleaned(texts):
            # the block's own element is the innermost open one that is not inline
            top = next(o for o in reversed(stack) if o.tag not in INLINE)
            heading = any(o.tag in HEADINGS for o in stack)
            share = min(1.0, len(cleaned(linked).split()) / len(text.split())) if linked else 0.0
            out.append((text, share, top.aside or (top.header and not heading), top.notice, top.main, top.article, heading))
        if text := cleaned(apart):
            out.append((text, 0.0, True, False, False, stack[-1].article, False))
        texts.clear()
        linked.clear()
        apart.clear()

    def add(text: str) -> None:
        block = next(o for o in reversed(stack) if o.tag not in INLINE)
        if stack[-1].aside and not block.aside:
            apart.append(text)
            texts.append(" ")
        else:
            texts.append(text)
            if any(o.tag == "a" for o in stack):
                linked.append(text + " ")

    pos, end = 0, len(page)
    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            add(page[pos:at])
        if at == end:
            break
        if page.startswith("<!--", at):
            stop = page.find("-->", at + 4)
            pos = end if stop < 0 else stop + 3
            continue
        m = _TAG.match(page, at)
        if not m:
            if page[at + 1 : at + 2] in ("!", "?", "/") or page[at + 1 : at + 2].isalpha():
                stop = page.find(">", at)
                pos = end if stop < 0 else stop + 1
            else:
                add("<")
                pos = at + 1
            continue
        pos = m.end()
        closing, tag, attributes = bool(m[1]), m[2].lower(), m[3]
        if tag in RAW and not closing:
            if attributes.endswith("/"):
                continue
            if tag != "head":
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            else:
                stop = re.compile(r"</head\s*>|(?=<body[\s>])", re.I).search(page, pos)
            if stop:
                pos = stop.end()
            elif tag in ("script", "style"):
                pos = end
            continue
        if tag in INLINE:
            if tag == "br":
                add(" ")
            elif closing:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        del stack[k]
                        break
            elif tag not in VOID and not attributes.endswith("/"):
                if tag == "a":  # a link cannot hold another
                    stack[1:] = [o for o in stack[1:] if o.tag != "a"]
                stack.append(_opened(tag, attributes, stack[-1]))
            continue
        close_block()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
        elif tag not in VOID and not attributes.endswith("/"):
            for same, beyond in (("p", ENDS_ITSELF["p"]), (tag, ENDS_ITSELF.get(tag))):
                for k in range(len(stack) - 1, 0, -1) if beyond is not None else ():
                    if stack[k].tag == same:
                        del stack[k:]
                        break
                    if stack[k].tag in beyond or (same == "p" and stack[k].tag not in INLINE):
                        break
            stack.append(_opened(tag, attributes, stack[-1]))
    close_block()
    return out


def features(found: list[Block]) -> list[list[float]]:
    """One row per block, in the order of FEATURES; link densities in hundredths. Runs are of blocks half linked or more."""
    sizes = [(len(text.split()), 100 * links) for text, links, *_ in found]
    runs = [0] * len(found)
    for linked, group in itertools.groupby(range(len(found)), key=lambda i: sizes[i][1] >= 50):
        if linked:
            at = list(group)
            runs[at[0] : at[-1] + 1] = [len(at)] * len(at)
    around = [(0, 0), *sizes, (0, 0)]
    return [[*sizes[i], *around[i], *around[i + 2], runs[i], *b[2:]] for i, b in enumerate(found)]


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n\n".join(b[0] for b, row in zip(found, features(found), strict=True) if classify(tree, row))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages.

    A null or empty html gives an empty text; repeated rows are read each for itself, null page_id and url pass
    through, an empty table gives no rows, other columns are ignored. A page is read whole, however long it is; a batch
    has a bounded number of rows and its texts are worked on one by one.
    """
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    tree = trained_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), tree) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
