"""Main text of HTML pages by a decision tree over flat text blocks.

A page is cut into text blocks at block-level tags.  A block has its number of
words and its link density, those of its neighbours, and what it stands in: an
article, a heading, navigation, an element beside the article, something whose
class or id has a word for such parts or for comments.  These words are features
among others.  An element that holds the page itself says nothing by its name
(:func:`_says_nothing`), nor does a class of html or body.  A decision tree,
trained on the small labelled table of :mod:`railtap.llm.html_labels`, keeps or
drops each block.  The kept blocks, character references decoded and white space
turned into single blanks, are joined by line breaks in page order.

Edge cases: a null or empty page, and one without kept blocks, gives an empty
text.  Pages and blocks of any length are used whole.  Tags that are never
closed end with what holds them, and a page that breaks off ends there.  Rows
are independent, so repeated rows and empty tables pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from railtap.llm.common import need

_TAG = re.compile(
    r"<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[a-z]+")

# Names of elements by what they do to the text, and words in classes and ids.
_RAW = frozenset("script style".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small "
                    "span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
           "th": ("td", "th"), "option": ("option",)}
_LIMITS = frozenset("ul ol dl table section article main div nav aside header footer form body blockquote select".split())
_UNSEEN = frozenset("head title noscript template svg iframe object canvas audio video textarea select option button datalist".split())
_NAV = frozenset("nav menu".split())
_SIDE = frozenset("header footer aside form dialog fieldset label".split())
_ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
_ASIDE_WORDS = frozenset(
    "nav navbar navigation menu header masthead banner footer sidebar aside ad ads adv advert adverts advertisement advertising "
    "sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert alerts popup modal overlay newsletter "
    "subscribe subscription signup login share sharing social breadcrumb breadcrumbs pagination pager related recommended "
    "recommendations widget toolbar copyright form search teaser".split())
_ASIDE_PARTS = re.compile(r"^(?:(?:left|right|side)(?:bar|col|column|rail)|ads?(?:box|slot|unit|sense|bar)|(?:top|sub|main|foot)(?:nav|menu))$").search
_COMMENT_PARTS = re.compile(r"^(?:comment|discuss|repl(?:y|ies)$|disqus|respond$|guestbook)").search
_COMMENTS = frozenset("comment comments reply replies".split())
_MAIN_WORDS = frozenset("article entry post story main content".split())
_LEGAL = re.compile(r"©|\(c\)|\ball rights reserved\b|\bcopyright\b", re.I).search


@dataclass
class Block:
    text: str
    words: int
    linked: int
    unseen: bool
    main: bool
    heading: bool
    inside: tuple[tuple[int, str], ...]
    kinds: frozenset[str] = frozenset()


def _kinds(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, set[str]]:
    """Whether the element is unseen, whether an article, and what else it says of its text: nav, side, named, comment."""
    unseen, main, kinds = tag in _UNSEEN, tag in ("article", "main"), set()
    if tag in _NAV:
        kinds.add("nav")
    elif tag in _SIDE and not (tag == "header" and in_article):  # an article's own header has its title
        kinds.add("side")
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id") and tag not in ("html", "body", "main"):
                # of an article only whole names count: "comment", but not "comment-open"
                words = set(value.split()) if tag == "article" else set(_NAME.findall(value))
                if not words.isdisjoint(_COMMENTS) if tag == "article" else any(map(_COMMENT_PARTS, words)):
                    kinds.add("comment")
                if not words.isdisjoint(_ASIDE_WORDS) or any(map(_ASIDE_PARTS, words)):
                    kinds.add("named")
                main = main or not set(_NAME.findall(value)).isdisjoint(_MAIN_WORDS)
            elif name == "role":
                main = main or value in ("main", "article")
                if value in _ASIDE_ROLES:
                    kinds.add("nav" if value in ("navigation", "menu", "menubar") else "side")
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                unseen = True
    return unseen, main, kinds


@dataclass
class _Element:
    tag: str
    kind: str
    article: bool = False
    title: bool = False
    words: int = 0


def _says_nothing(e: _Element, total: int, outside: bool) -> bool:
    """Whether an element holds the page itself, as its article, its title or most of its words show.

    ``outside`` tells that an article stands elsewhere.  Comments may hold articles and most of the words, so only the
    page's title tells that they are the page.
    """
    share = e.words / total if total else 0.0
    if e.kind == "comment":
        return e.title and share >= 0.5
    if e.tag in ("footer", "aside"):
        return share >= 0.9
    if e.article:
        return True
    if e.kind == "nav" or e.tag == "form":
        return not outside and share >= 0.6
    return not outside and (share >= 0.9 or e.title and share >= 0.6)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in page order."""
    out: list[Block] = []
    stack: list[tuple] = []   # tag, unseen, main, telling elements around and itself
    told: list[_Element] = []
    outside = False           # an article that no telling element holds
    text: list[str] = []
    linked: list[str] = []
    unseen = main = False
    inside: tuple[tuple[int, str], ...] = ()
    links = 0

    def close() -> None:
        if text:
            words = html.unescape("".join(text)).split()
            if words:
                n = len(html.unescape(" ".join(linked)).split()) if linked else 0
                head = any(t[0] in ("h1", "h2", "h3", "h4", "h5", "h6") for t in stack)
                out.append(Block(" ".join(words), len(words), min(n, len(words)), unseen, main, head, inside))
            text.clear()
            linked.clear()

    def say(part: str) -> None:
        if part:
            text.append(part)
            if links:
                linked.append(part)

    at, size = 0, len(page)
    while at < size:
        found = _TAG.search(page, at)
        if not found:
            say(page[at:])
            break
        say(page[at:found.start()])
        at = found.end()
        plain, ending, tag, attributes = found.groups()
        if plain is not None:
            say(html.escape(plain))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in _INLINE:
            close()
        elif tag == "br":
            say(" ")
        if ending:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    links -= sum(t[0] == "a" for t in stack[k:])
                    del stack[k:]
                    break
                if tag in _INLINE and stack[k][0] in _LIMITS:  # a stray end tag
                    break
            unseen, main, inside = stack[-1][1:] if stack else (False, False, ())
            continue
        if tag in _RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in _VOID or attributes.endswith("/"):
            continue
        if tag == "body":  # the end tag of a head may be left out
            for k in range(len(stack)):
                if stack[k][0] == "head":
                    del stack[k:]
                    links = sum(t[0] == "a" for t in stack)
                    break
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in _CLOSES.get(tag, ()):
                links -= sum(t[0] == "a" for t in stack[k:])
                del stack[k:]
                break
            if stack[k][0] in _LIMITS:
                break
        over = stack[-1] if stack else ("", False, False, ())
        hidden, article, kinds = _kinds(tag, attributes, over[2])
        around = over[3]
        for k, _ in around:
            told[k].title = told[k].title or tag == "h1"
            told[k].article = told[k].article or tag in ("main", "article")
        outside = outside or tag in ("main", "article") and not around
        for kind in sorted(kinds):
            around = (*around, (len(told), kind))
            told.append(_Element(tag, kind))
        stack.append((tag, over[1] or hidden, over[2] or article, around))
        unseen, main, inside = stack[-1][1:]
        links += tag == "a"
    close()
    total = 0
    for b in out:
        if not b.unseen:
            total += b.words
            for k, _ in b.inside:
                told[k].words += b.words
    nothing = {k for k, e in enumerate(told) if _says_nothing(e, total, outside)}
    for b in out:
        b.kinds = frozenset(kind for k, kind in b.inside if k not in nothing)
    return [b for b in out if not b.unseen]


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """What a block stands in, whether an article is elsewhere, a legal line outside one, then words and link density of it and its neighbours."""
    size = [(float(b.words), b.linked / b.words) for b in found]
    edge = (0.0, 0.0)
    somewhere = any(b.main and "comment" not in b.kinds for b in found)
    return [(*[float(k in b.kinds) for k in ("nav", "side", "named", "comment")], float(b.main), float(somewhere and not b.main),
             float(b.heading), float(not b.main and b.words < 30 and bool(_LEGAL(b.text))), *size[i], *(size[i - 1] if i else edge),
             *(size[i + 1] if i + 1 < len(size) else edge)) for i, b in enumerate(found)]


@dataclass
class Node:
    """A split (feature, bound: up to it goes left) or a leaf."""
    keep: bool
    feature: int = -1
    bound: float = 0.0
    left: Node | None = None
    right: Node | None = None

    def of(self, row: tuple[float, ...]) -> bool:
        node = self
        while node.left is not None:
            node = node.left if row[node.feature] <= node.bound else node.right
        return node.keep


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> Node:
    """A decision tree by the least Gini impurity; ties go to the first feature and bound."""
    node = Node(bool(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, good = x[order, f], np.cumsum(y[order])
        n = np.arange(1, len(y) + 1)
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        a, b = good[cut] / n[cut], (good[-1] - good[cut]) / (len(y) - n[cut])
        cost = n[cut] * a * (1 - a) + (len(y) - n[cut]) * b * (1 - b)
        k = int(cost.argmin())
        if best is None or cost[k] < best[0] - 1e-9:
            best = (float(cost[k]), f, float(v[cut[k]] + v[cut[k] + 1]) / 2)
    if best is None:
        return node
    _, node.feature, node.bound = best
    side = x[:, node.feature] <= node.bound
    node.left, node.right = grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1)
    return node


@lru_cache(maxsize=1)
def trained() -> Node:
    from railtap.llm import html_labels
    rows = [(f, keep) for page in html_labels.pages() for f, keep in zip(features(blocks(page.html)), page.labels(blocks), strict=True)]
    return grow(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))


def main_text(page: str | None, tree: Node) -> str:
    found = blocks(page or "")
    return "\n".join(b.text for b, f in zip(found, features(found)) if tree.of(f))


def extract(pages: DataFrame, tree: Node | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    tree = tree or trained()
    rows = need(pages, "page_id", "url", "html")
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, tree) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
