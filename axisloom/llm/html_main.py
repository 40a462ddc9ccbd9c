"""Main text of HTML pages: flat text blocks judged by a decision tree on shallow features.

A page becomes a flat list of text blocks. Each has its word count and link density, those of the
blocks before and after it, and two marks of where it stands: whether the page's article holds
it, and whether an element that says it is page furniture does (menus, headers, footers, sidebars,
notices, adverts, forms, comments). A small decision tree, grown at first use from the labelled
table below, keeps or drops each block. Its first splits are on words and links; marks of position
decide among blocks that look alike.

An element is furniture by its own tag, role, or a class or id that names furniture as a whole. A
name at the end of other words (``right-sidebar``) is a weak hint only, and elsewhere in them no hint. A marked element
that holds most of the article's words, or, on pages without an article, a large share of all words
under a mere name, is a wrapper and hints at nothing. Blocks without a mark or links between two kept blocks stay as well.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from axisloom.llm._worker import state

# Element names of HTML, and words that name page furniture.
RAW = frozenset("script style noscript template svg math iframe object canvas title textarea select".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("nav footer aside form dialog menu button fieldset".split())
ARTICLE = frozenset("article main".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th tr option".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager copyright skip "
    "contentinfo complementary search dialog alert header".split()
)
#: Words that leave a name of furniture what it is: ``site-footer``, ``comment-list``.
PLAIN_WORDS = frozenset("site page main global top bottom primary secondary post blog user reader article list box block bar item items section area body form text links link inner wrapper container row widget".split())
#: First words that say what the page has, not what the element is: ``has-sidebar``, ``no-comments``.
STATES = frozenset("has no with without is not hide show".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[^\W_]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: How sure a mark is: an element's tag, role, hiding or whole name; a name at the end of other words.
SURE, HINT = 1.0, 0.5


@dataclass
class Element:
    """An open element: its tag, what its text stands in, and what it says of itself."""

    tag: str
    above: Element | None
    article: bool = False
    own: float = 0.0
    named: bool = False  # furniture by class or id only
    wraps: bool = False  # around the main text
    words: int = 0
    article_words: int = 0

    def furniture(self) -> float:
        """The surest mark on the way up."""
        at, most = self, 0.0
        while at is not None:
            if not at.wraps:
                most = max(most, at.own)
            at = at.above
        return most


@dataclass
class Block:
    """A run of text between two block boundaries."""

    parts: list[str] = field(default_factory=list)
    text: str = ""
    words: int = 0
    linked: int = 0
    at: Element | None = None
    furniture: float = 0.0

    @property
    def density(self) -> float:
        return min(1.0, self.linked / self.words) if self.words else 0.0

    @property
    def article(self) -> bool:
        return self.at is not None and self.at.article


def _name_mark(name: str) -> float:
    """How sure a class or id is the name of furniture."""
    words = [w.lower() for w in WORDS.findall(CAMEL.sub(" ", name))]
    if not words or words[0] in STATES or not NAMES.intersection(words):
        return 0.0
    if NAMES.union(PLAIN_WORDS).issuperset(words):
        return SURE
    return HINT if words[-1] in NAMES else 0.0


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[float, bool]:
    """How sure an element is furniture, and whether by name only. Headers of an article belong to it."""
    header = ("header",) if in_article else ()
    if tag in FURNITURE or tag == "header" and not in_article:
        return SURE, False
    most = 0.0
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            return SURE, False
        if key == "role" and value.lower() in NAMES.difference(header):
            return SURE, False
        if key in ("class", "id"):
            most = max([most, *(_name_mark(n) for n in value.split() if n.lower() not in header)])
    return (0.0, False) if tag in ("html", "body", *ARTICLE) and most < SURE or tag in ("html", "body") else (most, most > 0)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in page order; empty ones are left out."""
    out: list[Block] = []
    now = Block()
    root = Element("", None)
    stack = [root]
    marked: list[Element] = []
    link = -1  # depth of the stack where the open link began
    at, end = 0, len(page)

    def close_block() -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            now.words = max(1, len(now.text.split()))
            out.append(now)
        now = Block()

    def add(raw: str) -> None:
        text = html.unescape(raw)
        if now.at is None and text.strip():
            now.at = stack[-1]
        now.parts.append(text)
        if link >= 0:
            now.linked += len(text.split())

    def enter(tag: str, attributes: str) -> None:
        top = stack[-1]
        own, named = _marks(tag, attributes, top.article)
        new = Element(tag, top, top.article or tag in ARTICLE and own == 0, own, named)
        if own:
            marked.append(new)
        stack.append(new)

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if name in RAW and not closing:
            if not attributes.rstrip().endswith("/"):
                ending = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
                at = ending.end() if ending else end
            continue
        if name == "br":
            now.parts.append(" ")
            continue
        if name == "a":
            link = -1 if closing else len(stack)
            continue
        if name in INLINE or name in VOID and name != "hr":
            if not closing and name in INLINE and attributes and _marks(name, attributes, stack[-1].article)[0]:
                close_block()
                enter(name, attributes)
            elif closing and stack[-1].tag == name:
                close_block()
                stack.pop()
            continue
        close_block()
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == name), None)
            if depth is not None:
                del stack[depth:]
        elif name != "hr":
            while stack[-1].tag == "p" or stack[-1].tag == name and name in PARAGRAPH or stack[-1].tag in INLINE:
                stack.pop()  # a paragraph ends where the next block begins; list items and cells end each other
            enter(name, attributes)
        if link > len(stack):
            link = -1
    close_block()
    if marked:
        _unmark_wrappers(out, marked)
    for b in out:
        b.furniture = b.at.furniture() if b.at is not None and marked else 0.0
    return out


def _unmark_wrappers(found: list[Block], marked: list[Element]) -> None:
    """Tell wrappers from furniture by the share of the article's words that they hold, or of all words where there is no article."""
    for b in found:
        up = b.at
        while up is not None:
            up.words += b.words
            up.article_words += b.words if b.article else 0
            up = up.above
    total, article = sum(b.words for b in found), sum(b.words for b in found if b.article)
    for e in marked:
        if article:
            e.wraps = not e.article and 2 * e.article_words > article
        else:
            e.wraps = e.named and e.words > (0.9 if e.own == SURE else 0.5) * total


FEATURES = ("words", "density", "words_before", "density_before", "words_after", "density_after", "article", "furniture")
#: Features of words and links, and marks of position.
SHALLOW, MARKS = range(6), range(6, 8)
#: A split on words or links has to gain so much, with so many labelled rows on each side.
LEAST_GAIN = 0.03
LEAST_ROWS = 4


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """Features of each block; beyond the ends of the page there are blocks of no words.

    ``article`` is 1 inside the article, -1 outside of it, 0 on a page without one.
    """
    has = any(b.article and b.furniture < SURE for b in found)
    edge = Block()
    rows = []
    for k, b in enumerate(found):
        before, after = found[k - 1] if k else edge, found[k + 1] if k + 1 < len(found) else edge
        rows.append((b.words, b.density, before.words, before.density, after.words, after.density, (1.0 if b.article else -1.0) if has else 0.0, b.furniture))
    return rows


#: Labelled blocks, written by hand for this module: the features in the order above, then 1 for main text.
LABELLED = (
    # menu entries and link lists
    (1, 1.0, 0, 0.0, 1, 1.0, -1, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 1, 0), (2, 1.0, 1, 1.0, 8, 0.0, -1, 1, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0),
    (1, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0), (6, 0.9, 5, 0.8, 7, 1.0, 0, 0, 0), (12, 0.8, 10, 0.9, 9, 0.7, 0, 0, 0), (25, 0.7, 30, 0.1, 12, 0.9, 0, 0, 0),
    (2, 1.0, 0, 0.0, 60, 0.0, 0, 0, 0), (5, 1.0, 1, 1.0, 90, 0.0, 0, 0, 0), (1, 1.0, 50, 0.0, 0, 0.0, 0, 0, 0), (4, 1.0, 60, 0.0, 45, 0.0, 0, 0, 0),
    (3, 0.8, 75, 0.0, 30, 0.0, 0, 0, 0),
    # more link lists: menus, related articles, page numbers, tags under an article
    (2, 1.0, 2, 1.0, 1, 1.0, -1, 1, 0), (1, 1.0, 2, 1.0, 3, 1.0, -1, 1, 0), (4, 1.0, 1, 1.0, 2, 1.0, -1, 0, 0), (1, 1.0, 30, 0.0, 1, 1.0, -1, 0, 0), (9, 1.0, 7, 1.0, 8, 1.0, -1, 0, 0), (8, 1.0, 9, 1.0, 0, 0.0, -1, 1, 0),
    (11, 1.0, 60, 0.0, 9, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (1, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (3, 1.0, 3, 1.0, 45, 0.0, 0, 0, 0), (7, 0.9, 6, 1.0, 0, 0.0, 0, 0.5, 0), (2, 1.0, 2, 1.0, 9, 0.0, 0, 0.5, 0),
    (5, 1.0, 80, 0.0, 5, 1.0, -1, 0, 0), (13, 1.0, 12, 1.0, 14, 1.0, -1, 0.5, 0), (30, 0.9, 25, 0.8, 40, 0.7, 0, 0, 0), (22, 0.8, 4, 1.0, 30, 0.9, -1, 1, 0), (6, 1.0, 4, 0.0, 6, 1.0, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, -1, 0, 0),
    # first and last blocks of the main text, next to menus and link lists
    (8, 0.0, 1, 1.0, 40, 0.0, 1, 0, 1), (5, 0.0, 3, 1.0, 70, 0.0, 1, 0, 1), (12, 0.0, 2, 1.0, 9, 0.0, 1, 0, 1), (60, 0.0, 4, 1.0, 50, 0.0, 1, 0, 1), (35, 0.0, 80, 0.0, 6, 1.0, 1, 0, 1), (3, 0.0, 55, 0.0, 2, 1.0, 1, 0, 1),
    (60, 0.0, 1, 1.0, 50, 0.0, 0, 0, 1), (32, 0.0, 5, 1.0, 41, 0.0, 0, 0, 1), (95, 0.0, 2, 1.0, 30, 0.0, 0, 0, 1), (48, 0.1, 12, 1.0, 7, 1.0, 0, 0, 1), (27, 0.0, 6, 1.0, 90, 0.0, 0, 0, 1), (110, 0.0, 75, 0.0, 4, 1.0, 0, 0, 1),
    (40, 0.0, 3, 1.0, 1, 1.0, 0, 0, 1), (150, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1), (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1), (6, 0.0, 1, 1.0, 33, 0.0, 0, 0, 1),
    # adverts, notices, forms, footers and comments inside furniture
    (7, 0.0, 2, 1.0, 9, 0.0, -1, 1, 0), (14, 0.0, 60, 0.0, 0, 0.0, -1, 1, 0), (30, 0.0, 80, 0.0, 25, 0.0, 1, 1, 0), (55, 0.05, 20, 0.0, 35, 0.0, -1, 1, 0),
    (5, 0.0, 40, 0.0, 3, 0.0, 1, 1, 0), (90, 0.0, 4, 0.0, 70, 0.0, 1, 1, 0), (18, 0.2, 3, 1.0, 2, 1.0, 0, 1, 0), (45, 0.0, 50, 0.0, 0, 0.0, 0, 1, 0),
    (6, 0.0, 5, 0.0, 60, 0.0, 1, 1, 0), (40, 0.0, 90, 0.0, 45, 0.0, 1, 1, 0), (2, 0.0, 70, 0.0, 50, 0.0, 0, 1, 0), (28, 0.0, 12, 0.0, 110, 0.0, 0, 1, 0),
    (75, 0.0, 40, 0.0, 30, 0.0, 1, 1, 0), (11, 0.3, 25, 0.1, 80, 0.0, -1, 1, 0), (16, 0.0, 45, 0.0, 55, 0.0, 1, 1, 0), (3, 0.0, 35, 0.0, 20, 0.0, 0, 1, 0),
    (22, 0.0, 15, 0.0, 16, 0.0, 0, 1, 0), (64, 0.0, 33, 0.0, 48, 0.0, 0, 1, 0), (1, 0.0, 44, 0.0, 31, 0.0, 1, 1, 0), (8, 0.5, 52, 0.0, 27, 0.0, -1, 1, 0),
    # loose text outside the article of a page that has one
    (9, 0.0, 1, 1.0, 10, 0.0, -1, 0, 0), (12, 0.1, 70, 0.0, 0, 0.0, -1, 0, 0), (35, 0.0, 60, 0.0, 3, 1.0, -1, 0, 0), (3, 0.0, 0, 0.0, 1, 1.0, -1, 0, 0),
    (24, 0.0, 45, 0.0, 50, 0.0, -1, 0, 0), (60, 0.0, 8, 0.0, 40, 0.0, -1, 0, 0), (5, 0.0, 30, 0.0, 45, 0.0, -1, 0, 0), (110, 0.0, 20, 0.0, 35, 0.0, -1, 0, 0),
    # headings, paragraphs and short lines of an article element
    (10, 0.0, 8, 0.0, 40, 0.0, 1, 0, 1), (3, 0.0, 2, 1.0, 25, 0.0, 1, 0, 1), (1, 0.0, 50, 0.0, 60, 0.0, 1, 0, 1), (45, 0.0, 10, 0.0, 80, 0.0, 1, 0, 1),
    (120, 0.02, 60, 0.0, 45, 0.1, 1, 0, 1), (4, 0.0, 90, 0.0, 14, 0.0, 1, 0, 1), (30, 0.3, 55, 0.0, 12, 0.0, 1, 0, 1), (2, 0.0, 5, 0.0, 7, 0.0, 1, 0, 1),
    (7, 1.0, 30, 0.0, 45, 0.0, 1, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (6, 0.0, 45, 0.0, 5, 0.0, 1, 0, 1), (20, 0.0, 30, 0.0, 8, 0.0, 1, 0, 1),
    (1, 0.0, 1, 1.0, 1, 1.0, 1, 0, 1), (5, 0.6, 40, 0.0, 3, 1.0, 1, 0, 1), (12, 0.0, 4, 0.0, 0, 0.0, 1, 0, 1), (3, 1.0, 4, 1.0, 3, 1.0, 1, 0, 1),
    # the same on pages without such an element
    (45, 0.0, 8, 0.0, 60, 0.0, 0, 0, 1), (80, 0.05, 40, 0.0, 50, 0.0, 0, 0, 1), (25, 0.0, 3, 1.0, 45, 0.0, 0, 0, 1), (16, 0.0, 40, 0.0, 50, 0.1, 0, 0, 1),
    (8, 0.0, 2, 1.0, 45, 0.0, 0, 0, 1), (5, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (30, 0.1, 25, 0.0, 4, 1.0, 0, 0, 1), (22, 0.2, 45, 0.0, 30, 0.0, 0, 0, 1),
    (50, 0.0, 60, 0.0, 1, 1.0, 0, 0, 1), (120, 0.0, 80, 0.0, 0, 0.0, 0, 0, 1), (45, 0.0, 30, 0.0, 2, 1.0, 0, 0, 1), (70, 0.02, 2, 1.0, 3, 0.0, 0, 0, 1),
    (35, 0.0, 90, 0.0, 6, 0.8, 0, 0, 1), (60, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1), (90, 0.1, 55, 0.0, 12, 0.0, 0, 0, 1), (28, 0.0, 40, 0.0, 8, 0.0, 0, 0, 1),
    # short unlinked scraps among links, without an article
    (3, 0.0, 2, 1.0, 2, 1.0, -1, 0, 0), (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0), (6, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0), (8, 0.0, 30, 0.9, 0, 0.0, 0, 0, 0),
    (5, 0.0, 4, 1.0, 3, 1.0, 0, 0, 0), (9, 0.2, 50, 0.8, 4, 1.0, 0, 0, 0), (2, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0), (7, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0),
    # short pages of short blocks without links or marks
    (2, 0.0, 0, 0.0, 6, 0.0, 0, 0, 1), (6, 0.0, 2, 0.0, 4, 0.0, 0, 0, 1), (4, 0.0, 6, 0.0, 0, 0.0, 0, 0, 1), (9, 0.0, 3, 0.0, 5, 0.0, 0, 0, 1),
    (12, 0.0, 9, 0.0, 8, 0.0, 0, 0, 1), (3, 0.0, 0, 0.0, 9, 0.0, 0, 0, 1), (7, 0.0, 12, 0.0, 0, 0.0, 0, 0, 1), (1, 0.0, 5, 0.0, 7, 0.0, 0, 0, 1),
    (10, 0.1, 8, 0.0, 11, 0.0, 0, 0, 1), (5, 0.0, 70, 0.0, 0, 0.0, 0, 0, 1), (8, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1),
    # under a weak hint: scraps are furniture, running text is not
    (4, 0.0, 0, 0.0, 3, 0.0, 0, 0.5, 0), (3, 0.0, 6, 0.0, 5, 1.0, 0, 0.5, 0), (9, 0.0, 40, 0.0, 2, 1.0, 0, 0.5, 0), (6, 0.2, 3, 0.5, 8, 0.0, -1, 0.5, 0),
    (14, 0.0, 5, 1.0, 11, 0.0, 0, 0.5, 0), (55, 0.0, 12, 0.0, 80, 0.0, 0, 0.5, 1), (120, 0.0, 0, 0.0, 0, 0.0, 0, 0.5, 1), (80, 0.05, 55, 0.0, 40, 0.0, 0, 0.5, 1),
    (45, 0.0, 70, 0.0, 60, 0.0, 0, 0.5, 1), (5, 0.0, 40, 0.0, 60, 0.0, 1, 0.5, 1), (40, 0.0, 5, 0.0, 12, 0.0, 1, 0.5, 1), (65, 0.0, 30, 0.0, 9, 0.0, 1, 0.5, 1),
    (2, 0.0, 22, 0.0, 35, 0.0, 1, 0.5, 1),
)


def _gini(rows: list[tuple[float, ...]]) -> float:
    share = sum(r[-1] for r in rows) / len(rows)
    return 2 * share * (1 - share)


def _best_split(rows: list[tuple[float, ...]], among: Iterable[int], least: int):
    """The split of most gain on one of some features, each side having ``least`` rows."""
    best = None
    for f in among:
        values = sorted({r[f] for r in rows})
        for low, high in zip(values, values[1:], strict=False):
            cut = (low + high) / 2
            left, right = [r for r in rows if r[f] <= cut], [r for r in rows if r[f] > cut]
            gain = _gini(rows) - (len(left) * _gini(left) + len(right) * _gini(right)) / len(rows)
            if min(len(left), len(right)) >= least and (best is None or gain > best[0] + 1e-12):
                best = gain, f, cut, left, right
    return best


def grow(rows: list[tuple[float, ...]], depth: int = 8):
    """A decision tree as nested (feature, threshold, at most, above), with 0 or 1 in its leaves.

    Words and links split first. Where they tell rows apart no more, marks of position split.
    """
    ones = sum(r[-1] for r in rows)
    if depth == 0 or ones in (0, len(rows)):
        return int(2 * ones > len(rows))
    best = _best_split(rows, SHALLOW, LEAST_ROWS)
    if best is None or best[0] < LEAST_GAIN:
        best = _best_split(rows, MARKS, 1)
    if best is None:
        return int(2 * ones > len(rows))
    _, f, cut, left, right = best
    low, high = grow(left, depth - 1), grow(right, depth - 1)
    return low if low == high else (f, cut, low, high)


def judge(tree, row: tuple[float, ...]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


_TREE: list = []


def main_text(page: str | None, tree=None) -> str:
    """The main text of a page: kept blocks in page order, joined by an empty line."""
    if not page:
        return ""
    if tree is None:
        if not _TREE:
            _TREE.append(grow(list(LABELLED)))
        tree = _TREE[0]
    found = blocks(page)
    rows = features(found)
    kept = [judge(tree, row) for row in rows]
    between = [0 < k < len(found) - 1 and kept[k - 1] and kept[k + 1] and row[1] == row[7] == 0 and rows[k - 1][6] == row[6] for k, row in enumerate(rows)]
    return "\n\n".join(b.text for b, one, other in zip(found, kept, between, strict=True) if one or other)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each page: id, url, ``text`` and ``n_chars`` (its code points).

    A null or empty page, and one without main text, gives an empty text; null ids and urls stay
    null; repeated rows are each extracted; an empty table gives an empty one; pages are read
    whole, however long, one at a time; other columns are ignored, whatever their names. Ids must
    be whole numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state("html")
        tree = grow(list(LABELLED))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                few = batch.slice(at, 256)
                texts = [main_text(p.as_py(), tree) for p in few.column(2)]
                cols = [few.column(0), few.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "url", "text", "n_chars"])

    slim = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return slim.mapInArrow(run, "id long, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
