"""Main-text extraction from HTML by tag-path ratios.

A page is read once into blocks, each with the path of elements from the root to it (with their classes and ids).
Over the page, text length and punctuation are aggregated per path; a path's two ratios (per block) are smoothed over
the blocks in page order and fused into one score; blocks whose smoothed and own scores are over a share of the mean are
content nodes. The lowest element that holds all content nodes holds the article, and its blocks are the text: a short
paragraph or heading beside long ones is kept, whatever its own ratio. If that element is a part of a text only (a
paragraph, list, table, quote), the one around it is taken, and if it is in an article or main element, the outermost of
these. Elements whose tag, class or id says that they are something else (menus, headers of the page, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments) take no part; where a name is doubtful (a "legal-analysis"
may be the article, a "legal" or "legal-box" is not), its blocks stay if their tag-path ratios are as high as the median
content node's.

A page is read in one pass forward and elements keep no paths as text, so time and memory grow with the page alone.

Defined results: a null or empty page, or one without such text, gives an empty text; broken markup (elements that
aren't closed or not open, cut references, an open comment or script at the end) is read as browsers do in the main;
repeated pages each get their own row; pages are read whole.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from statistics import median

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ..session import ship
from . import words

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/]++)")
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？।]")
_TOKENS = re.compile(r"[a-z]+")

#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that don't begin a new block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text.
OTHER = frozenset("head nav footer aside form script style noscript template iframe object embed svg math canvas audio video select button option label input textarea fieldset dialog menu title noembed noframes map".split())
#: Words in a class, an id or a role that say the same.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo banner cookie cookies consent gdpr popup modal overlay newsletter nav navbar navigation menu breadcrumb breadcrumbs pagination pager sidebar sidebars widget widgets footer foot masthead topbar toolbar comment comments disqus complementary contentinfo".split()
)
#: Words that say so where a name has no other words than these and ``FRAME_WORDS``; beside another word they leave it to the ratios.
DOUBTFUL_WORDS = frozenset(
    "promotion notice notices notification alert subscribe subscription signup login side related recommended recommendations share sharing social reply replies respond copyright legal disclaimer search".split()
)
#: Words of names that say nothing.
FRAME_WORDS = frozenset("a an and area articles bar block box btn button buttons bottom center column container content group header heading inner item items left link links list main of on outer page panel posts right row section stories text the this title to top wrap wrapper".split())
#: Page headers; inside an article they hold its own heading.
HEADER = frozenset({"header", "banner"})
ARTICLE = frozenset({"article", "main"})
_CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_P_SCOPE = frozenset("button table td th li article div section".split())
_ITEMS = frozenset(_SIBLINGS).union(*_SCOPE.values())
#: Share of the mean fused score from which a block is a content node.
THRESHOLD = 0.35
#: Elements that hold a part of a text only; the text goes on around them.
PART = frozenset("p h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption details summary address center".split())


class Element:
    """An open or closed element. Paths are numbered within a page: elements of the same path have the same number.

    ``other``: it holds no article text; ``doubtful``: so its label says; ``outermost``: the first of the elements around it
    that is other; ``p``: the open paragraph that a block in it closes; ``item``: the nearest list item, cell or their list.
    """

    __slots__ = ("tag", "path", "up", "other", "doubtful", "article", "outermost", "p", "item", "number")

    def __init__(self, tag: str, path: int, up: Element | None, other: bool, doubtful: bool, article: bool):
        self.tag, self.path, self.up = tag, path, up
        self.other, self.doubtful, self.article, self.number = other, doubtful, article, 0
        self.outermost = (up.outermost if up else None) or (self if other else None)
        self.p = self if tag == "p" else None if tag in _P_SCOPE or up is None else up.p
        self.item = self if tag in _ITEMS else up.item if up else None


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text and not text.isspace() else {}


def _open(tag: str, attrs: str, up: Element, paths: dict[tuple[int, str], int]) -> Element:
    a = _attributes(attrs)
    label = " ".join(a.get(k, "") for k in ("class", "id", "role")).lower()
    words = set(_TOKENS.findall(label))
    own = tag in ("html", "body", "article", "main")
    article = up.article or tag in ARTICLE or "main" in _TOKENS.findall(a.get("role", "").lower())
    other = up.other or tag in OTHER or bool(words & OTHER_WORDS and not own)
    other = other or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower()
    if not up.article and (tag == "header" or words & HEADER and not own):
        other = True
    doubtful = up.doubtful
    for name in () if own else label.split():
        parts = set(_TOKENS.findall(name))
        if parts & DOUBTFUL_WORDS:
            plain = parts <= DOUBTFUL_WORDS | FRAME_WORDS
            other, doubtful = other or plain, doubtful or not plain
    path = paths.setdefault((up.path, tag + "".join(f".{w}" for w in sorted(words))), len(paths) + 1)
    return Element(tag, path, up, other, doubtful, article)


def tokens(html: str) -> Iterator[tuple[str, str, bool, str]]:
    """The page's text (tag empty) and tags (name, whether it closes, attributes) in one pass forward.

    A ">" in a quoted value does not end a tag, but a quote that is never closed is a character like others; where quotes run
    on to the page's end without one, tags end at their first ">" from there on.
    """
    at, n, quoted, no_more = 0, len(html), True, set()
    while at < n:
        i = html.find("<", at)
        if i < 0:
            yield "", html[at:], False, ""
            return
        if i > at:
            yield "", html[at:i], False, ""
        if html.startswith("<!--", i):
            end = html.find("-->", i + 4)
            at = n if end < 0 else end + 3
            continue
        if html.startswith("<![CDATA[", i) and "]]>" not in no_more:
            end = html.find("]]>", i + 9)
            if end >= 0:
                yield "", html[i + 9 : end].replace("&", "&amp;"), False, ""
                at = end + 3
                continue
            no_more.add("]]>")
        if html[i + 1 : i + 2] in ("!", "?"):
            end = html.find(">", i)
            at = n if end < 0 else end + 1
            continue
        closing = html.startswith("/", i + 1)
        m = _NAME.match(html, i + 1 + closing)
        if m is None or ">" in no_more:
            yield "", "<", False, ""
            at = i + 1
            continue
        end = m.end()
        while quoted and (stop := _STOP.search(html, end)) and stop[0] != ">":
            close = -1 if stop[0] in no_more else html.find(stop[0], stop.end())
            if close < 0:
                no_more.add(stop[0])
            end = stop.end() if close < 0 else close + 1
        if quoted and stop is None:
            quoted = False
        end = stop.start() if quoted else html.find(">", m.end())
        if end < 0:
            no_more.add(">")
            yield "", "<", False, ""
            at = i + 1
            continue
        at = end + 1
        tag = m[0].lower()
        if tag in RAW and not closing:
            close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
            at = close.start() if close else n
            continue
        yield tag, "", closing, html[m.end() : end]


def blocks(html: str) -> list[tuple[str, Element]]:
    """The page's blocks in order: text with its white space turned into single spaces, and the element it is in."""
    return _read(html)[0]


def _read(html: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """The page's blocks, and its elements in the order in which they open, numbered."""
    root = Element("", 0, None, False, False, False)
    here, out, held, elements, paths = root, [], [], [root], {}
    is_open: dict[str, int] = defaultdict(int)  # open elements by tag

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append((text, here))

    def close(e: Element) -> None:
        """Close e and all that is open in it."""
        nonlocal here
        while here is not e.up:
            is_open[here.tag] -= 1
            here = here.up

    for tag, text, closing, attrs in tokens(html):
        if not tag:
            held.append(unescape(text))
            continue
        if tag in RAW:
            continue
        if tag in INLINE:
            if tag in ("br", "img"):
                held.append(" ")
            continue
        flush()
        if closing:
            if is_open[tag]:
                e = here
                while e.tag != tag:
                    e = e.up
                close(e)
            continue
        if tag in VOID:
            continue
        if tag in _CLOSES_P and here.p is not None:
            close(here.p)
        if tag in _SIBLINGS:
            e = here.item
            while e is not None and e.tag not in _SIBLINGS[tag] and e.tag not in _SCOPE[tag]:
                e = e.up.item
            if e is not None and e.tag in _SIBLINGS[tag]:
                close(e)
                if tag == "tr" and here.tag == "tr":
                    close(here)
        if tag in ARTICLE:  # an article doesn't stand in a menu or notice that was left open
            top = here.outermost
            if top is not None and top.tag in ("nav", "header", "footer", "aside", "form", "head", "div", "p"):
                close(top)
        here = _open(tag, attrs, here, paths)
        here.number = len(elements)
        elements.append(here)
        is_open[tag] += 1
    flush()
    return out, elements


def _smooth(values: list[float]) -> list[float]:
    n = len(values)
    return [(values[max(i - 1, 0)] + 2 * values[i] + values[min(i + 1, n - 1)]) / 4 for i in range(n)]


def ratios(nodes: list[tuple[str, Element]]) -> tuple[list[float], list[float]]:
    """Tag-path ratios of some blocks: text length and punctuation per block of the same path."""
    length, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for text, e in nodes:
        length[e.path] += len(text)
        marks[e.path] += len(_PUNCTUATION.findall(text))
        count[e.path] += 1
    return [length[e.path] / count[e.path] for _, e in nodes], [marks[e.path] / count[e.path] for _, e in nodes]


def _fused(text_ratio: list[float], mark_ratio: list[float]) -> list[float]:
    return [t * (1.0 + p) for t, p in zip(text_ratio, mark_ratio, strict=True)]


def scores(nodes: list[tuple[str, Element]]) -> list[float]:
    """Fused, smoothed tag-path ratios of some blocks."""
    return _fused(*map(_smooth, ratios(nodes)))


def main_blocks(html: str | None) -> list[str]:
    """The article's blocks."""
    found, elements = _read(html or "")
    every = [(t, e) for t, e in found if not e.other]
    nodes = [(t, e) for t, e in every if not e.doubtful]
    if not nodes:
        return []
    each = ratios(nodes)
    own, fused = _fused(*each), _fused(*map(_smooth, each))
    least = THRESHOLD * sum(fused) / len(fused)
    # a block that owes its score to its neighbours chooses nothing
    chosen = [i for i, (s, o) in enumerate(zip(fused, own, strict=True)) if s >= least and o >= least] or [i for i, s in enumerate(fused) if s >= least]
    held = [0] * len(elements)  # content nodes in an element
    for i in chosen:
        held[nodes[i][1].number] += 1
    top = elements[0]
    for e in reversed(elements):
        if held[e.number] == len(chosen):
            top = e
            break
        held[e.up.number] += held[e.number]
    while top.tag in PART and top.up is not None:
        top = top.up
    e = top
    while e is not None:
        top, e = e if e.tag in ARTICLE else top, e.up
    inside = [False] * len(elements)
    for e in elements:
        inside[e.number] = e is top or e.up is not None and inside[e.up.number]
    dense = dict(zip((id(e) for _, e in every), _fused(*ratios(every)), strict=True))
    bar = median(own[i] for i in chosen)
    return [t for t, e in every if inside[e.number] and (not e.doubtful or dense[id(e)] >= bar)]


def _texts(html: pa.Array) -> pa.Array:
    return pa.array(["\n".join(main_blocks(h)) for h in html.to_pylist()], pa.string())


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with a column ``out`` (it replaces one of that name): the main text, blocks joined by line ends."""
    ship(pages.sparkSession)
    return pages.withColumn(out, arrow_udf(words.bounded(_texts), returnType="string").asNondeterministic()(F.col(html_col)))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
