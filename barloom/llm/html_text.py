"""Main text of web pages from flat text blocks.

A page is cut into blocks at block-level tags. What the page itself marks as something else than article (menus, headers, footers,
asides, and comments) is set aside. Every other block is described by its words and link density and those of the blocks before and after
it, and a decision tree, trained on the small labelled table below, says which of them are article text.

The name of an element (as "sidebar", "banner") and a form are hints, which the whole page confirms or refutes: an element named so is set aside unless it holds most of
the page's words and prose among them, as a wrapper does that is named after a part of it. Names of a state ("no-sidebar", "search-page") say nothing. Inside an article
element names count less: only those that say nothing but "advert" or "comments" set a block aside.

Reading a page takes time in proportion to its length, whatever its markup: every search for the end of a tag, a quote or a comment either moves
on to what it finds, or is known beforehand to find nothing.
"""

from __future__ import annotations

import html as html_entities
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tag names of HTML and words that sites name their page furniture with.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col colgroup embed hr img input link meta param source track wbr".split())
#: Their content is no markup; without an end tag it goes to the end of the page.
RAW = frozenset("script style textarea title".split())
#: Dropped with all they hold. Those of the first line end at the next block, too.
DROPPED_INLINE = frozenset("svg iframe select button datalist".split())
DROPPED = DROPPED_INLINE | frozenset("noscript template".split())
FURNITURE = frozenset("nav header footer aside dialog menu".split())
MAIN = frozenset(("article", "main"))
#: What stays open at a block's start or end; a link may hold blocks.
OWN_BLOCKS = BLOCK | DROPPED | {"", "a"}
#: Elements that say nothing of their text.
PLAIN = frozenset("html head body".split())
#: Set a block aside wherever they are.
ADVERT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner promo promotion promoted sponsor sponsored cookie cookies consent gdpr notice notices newsletter subscribe signup popup modal overlay "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar related recommended share sharing social pagination pager".split()
)
#: Set it aside outside of an article only.
PAGE_WORDS = frozenset("alert copyright footer header masthead topbar toolbar side toc widget login search tags complementary contentinfo".split())
COMMENT_WORDS = frozenset("comment comments commentlist reply replies disqus respond reviews".split())
CONTENT_WORDS = frozenset("content main article articlebody post entry story".split())
#: First and last words of names that tell a state, or what kind of page it is, and not what an element holds.
STATE_FIRST = frozenset("no not has have with without is are hide hides show shows".split())
STATE_LAST = frozenset("page layout template theme enabled disabled active open opened closed visible hidden site view mode".split())
#: A part of a line that is named so is left out of it.
INLINE_ADVERT = frozenset("ad ads adv advert adverts advertisement advertisements sponsored promoted".split())
#: Words that change nothing in a name.
FILLING = frozenset("area articles bar block body bottom box buttons column container content footer form group header inline inner item items left link links list main module outer panel posts right section slot stories the top unit widget wrap wrapper".split())

_ATTRIBUTES = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|"[^">]*+"|'[^'>]*+')?+)*+>""")
_TAG = re.compile(r"[a-zA-Z][^\s/>]*+")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "heading")


#: (kind, value, attributes): text, the open or close of an element, or raw: an element whose content is left out. Plain tuples: there are many.
Token = tuple[str, str, str]


def tokens_of(html: str) -> Iterator[Token]:
    """The page as tokens. Comments and declarations are left out; a tag that the page's end cuts off is, too.

    A quoted value ends at the next such quote; if that is followed by what no tag has there and the value holds a `>`, the quote was
    never closed and the tag ends at that `>`.
    """
    last_comment, last_close = html.rfind("-->"), html.rfind(">")
    broken = False  # no tag end was found up to the page's end: from there on quotes mean nothing
    at = text_from = 0
    while (start := html.find("<", at)) >= 0 and start < last_close:
        following = html[start + 1 : start + 2]
        kind, name, attributes = "", "", ""
        if found := _TAG.match(html, start + 1):
            kind, name = "open", found[0].lower()
            end = None if broken else _ATTRIBUTES.match(html, found.end())
            broken = end is None
            to = end.end() if end else html.find(">", start) + 1
            attributes = html[found.end() : to - 1]
        elif following == "/":
            if found := _TAG.match(html, start + 2):
                kind, name = "close", found[0].lower()
            to = html.find(">", start) + 1
        elif following == "!" and html.startswith("<!--", start):
            if html.startswith((">", "->"), start + 4):
                to = html.find(">", start) + 1
            elif start + 4 <= last_comment:
                to = html.find("-->", start + 4) + 3
            else:
                to = html.find(">", start) + 1
        elif following in ("!", "?"):
            to = html.find(">", start) + 1
        else:
            at = start + 1
            continue
        if start > text_from:
            yield "text", html[text_from:start], ""
        if kind == "open" and name in RAW and not attributes.endswith("/"):
            ended = _RAW_END[name].search(html, to)
            yield "raw", name, ""
            to = html.find(">", ended.start()) + 1 if ended else len(html)
            to = to or len(html)
        elif kind:
            yield kind, name, attributes
        at = text_from = to
    cut = html.find("<", at)
    while cut >= 0 and not (html[cut + 1 : cut + 2].isalpha() or html[cut + 1 : cut + 2] in ("/", "!", "?")):
        cut = html.find("<", cut + 1)
    rest = html[text_from : cut if cut >= 0 else len(html)]
    if rest:
        yield "text", rest, ""


class Block(NamedTuple):
    text: str
    words: int
    link_words: int
    aside: bool
    article: bool
    heading: bool
    hint: int = -1  # the innermost element around it that its name, or being a form, may set aside
    content: bool = False  # whether an element named as content stands between that one and the block


class _Open(NamedTuple):
    tag: str
    furniture: str  # the innermost tag around it that is page furniture
    comment: bool
    article: bool
    link: bool
    dropped: bool
    hint: int
    content: bool
    inline: int  # in a part of a line that is named as an aside: 1, or as an advert: 2


_ROOT = _Open("", "", False, False, False, False, -1, False, 0)


class _Hint:
    """An element that may be set aside: exact if its name says nothing else."""

    def __init__(self, parent: int, exact: bool):
        self.parent, self.exact = parent, exact
        self.words = self.content_words = self.prose = self.headings = 0  # words outside of links

    def wrapper(self, page_words: int) -> bool:
        """Whether it holds the page's text: most words, and prose or content that is named so, or nearly all words and a heading. If its name is exact it
        must hold content that is named so, or nearly all words in several blocks of prose, or with a heading."""
        if 2 * self.words < page_words or not self.words:
            return False
        named, nearly_all = 2 * self.content_words >= self.words, 10 * self.words >= 9 * page_words
        if not self.exact:
            return self.prose > 0 or named or nearly_all and self.headings > 0
        return self.prose > 0 and (named or nearly_all and (self.prose >= 3 or self.headings > 0))


def _named(attributes: str, article: bool) -> tuple[str, bool, bool]:
    """What the names of an element say: comment, aside, article or nothing; whether one says nothing else; whether it is an advert's."""
    said, exact, advert = "", False, False
    for found in _NAMES.findall(attributes):
        for name in "".join(found).split():
            in_order = [w.lower() for w in _NAME_WORD.findall(name)]
            words = set(in_order)
            if not words or len(in_order) > 1 and (in_order[0] in STATE_FIRST or in_order[-1] in STATE_LAST):
                continue
            telling = words - FILLING
            if article:
                # A name of the article's own may hold such a word: related-work is no list of related pages.
                if words & COMMENT_WORDS and words <= COMMENT_WORDS | FILLING | CONTENT_WORDS | {"user", "reader"}:
                    return "comment", True, False
                if words & ADVERT_WORDS and words <= ADVERT_WORDS | PAGE_WORDS | FILLING | {"bottom", "top"}:
                    return "aside", True, bool(words & INLINE_ADVERT)
            elif words & COMMENT_WORDS:
                return "comment", True, False
            elif words & (ADVERT_WORDS | PAGE_WORDS):
                said, exact, advert = "aside", exact or telling <= ADVERT_WORDS | PAGE_WORDS, advert or bool(words & INLINE_ADVERT)
            elif words & CONTENT_WORDS and not said:
                said = "article"
    return said, exact, advert


#: Elements that mean something without an attribute.
_TELLING = MAIN | FURNITURE | DROPPED | {"a", "form"}


def _opened(tag: str, attributes: str, up: _Open, hints: list[_Hint], closed: Callable[[str], bool]) -> _Open:
    """An element under `up`. closed: whether every open element of a tag has its end tag still to come."""
    if not attributes and tag not in _TELLING:
        return _Open(tag, *up[1:])
    furniture, comment, article, hint, content, inline = up.furniture, up.comment, up.article, up.hint, up.content, up.inline

    def hinted(exact: bool) -> None:
        nonlocal hint, content
        hints.append(_Hint(hint, exact))
        hint, content = len(hints) - 1, False

    said, exact, advert = _named(attributes, article) if "=" in attributes and tag not in PLAIN else ("", False, False)
    if tag in MAIN:
        if not comment:
            article, hint = True, -1  # an advert that was never closed doesn't hold the article
            if furniture and not closed(furniture):
                furniture = ""
        said = said if said == "comment" else ""
    elif tag in FURNITURE and not (tag == "header" and article):
        if closed(tag):
            furniture = tag
        else:
            hinted(False)
    elif tag == "form":
        hinted(False)
    if said == "comment":
        comment = True
    elif said == "aside":
        if tag in BLOCK:
            hinted(exact)
        elif exact:
            inline = max(inline, 2 if advert else 1)
    elif said == "article" and not comment:
        article, content = article or hint < 0, True
    return _Open(tag, furniture, comment, article, up.link or tag == "a", up.dropped or tag in DROPPED, hint, content, inline)


def _settled(blocks: list[Block], hints: list[_Hint]) -> list[Block]:
    """The blocks with the hints decided; time is linear in both."""
    if not hints:
        return blocks
    page_words = 0
    for b in blocks:
        if not b.aside:
            own = b.words - b.link_words
            page_words += own
            if b.hint >= 0:
                h = hints[b.hint]
                h.words += own
                h.content_words += own if b.content else 0
                h.prose += b.words >= 20 and 3 * b.link_words < b.words
                h.headings += b.heading
    for h in reversed(hints):  # inner ones come after the outer ones
        if h.parent >= 0:
            outer = hints[h.parent]
            outer.words += h.words
            outer.content_words += h.content_words
            outer.prose += h.prose
            outer.headings += h.headings
    aside: list[bool] = []
    for h in hints:
        aside.append(h.parent >= 0 and aside[h.parent] or not h.wrapper(page_words))
    return [b._replace(aside=True) if b.hint >= 0 and aside[b.hint] else b for b in blocks]


def blocks_of(html: str | None) -> list[Block]:
    """The text blocks in page order, white space already turned into single spaces; empty blocks are left out."""
    html = html or ""
    out: list[Block] = []
    stack: list[_Open] = [_ROOT]
    depth: dict[str, int] = {}  # how many open elements of a name there are: an end tag without one is not searched for
    pieces: list[str] = []
    linked: list[str] = []
    heading = False
    ends_left: dict[str, int] = {}  # end tags of dropped elements and furniture that are still to come
    begins_left: dict[str, int] = {}  # and their start tags
    hints: list[_Hint] = []
    inline = 0  # open elements that are no blocks
    plainly = False  # whether the block has text outside of inline asides

    def closed(tag: str) -> bool:
        """Whether as many end tags as are needed are to come; called before the start tag at hand counts as open, and after it counts as seen."""
        return ends_left.get(tag, 0) - begins_left.get(tag, 0) >= max(1, depth.get(tag, 0))

    def push(o: _Open) -> None:
        nonlocal inline
        stack.append(o)
        depth[o.tag] = depth.get(o.tag, 0) + 1
        inline += o.tag not in BLOCK

    def cut(k: int) -> None:
        nonlocal inline
        for o in stack[k:]:
            depth[o.tag] -= 1
            inline -= o.tag not in BLOCK
        del stack[k:]

    def topmost(tag: str) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag)

    def close() -> None:
        nonlocal heading, plainly
        if pieces:
            raw = "".join(pieces)
            words = (html_entities.unescape(raw) if "&" in raw else raw).split()
            if words:
                link_words = len(html_entities.unescape("".join(linked)).split()) if linked else 0
                up = stack[-1]
                out.append(Block(" ".join(words), len(words), min(link_words, len(words)), bool(up.furniture) or up.comment or not plainly, up.article, heading, up.hint, up.content))
            pieces.clear()
            linked.clear()
        heading = plainly = False

    def text(piece: str) -> None:
        nonlocal plainly
        up = stack[-1]
        if not up.dropped and up.inline < 2:
            pieces.append(piece)
            if up.link:
                linked.append(piece)
            plainly = plainly or not up.inline and not piece.isspace()

    tokens = list(tokens_of(html))
    for kind, tag, _ in tokens:
        if tag in DROPPED or tag in FURNITURE:
            if kind == "close":
                ends_left[tag] = ends_left.get(tag, 0) + 1
            elif kind == "open":
                begins_left[tag] = begins_left.get(tag, 0) + 1
    for kind, tag, attributes in tokens:
        if tag in FURNITURE and kind != "text":
            left = ends_left if kind == "close" else begins_left
            left[tag] = left.get(tag, 0) - 1
        if kind == "text":
            text(tag)
        elif kind == "raw":
            if tag == "title":
                close()
        elif tag == "br":
            text(" ")
        elif tag in DROPPED:
            if kind == "close":
                ends_left[tag] -= 1
                if depth.get(tag):
                    cut(topmost(tag))
            elif ends_left.get(tag) and not attributes.endswith("/"):
                push(_opened(tag, attributes, stack[-1], hints, closed))
        elif tag not in BLOCK:
            if kind == "close":
                if not depth.get(tag):
                    continue
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        later = [o._replace(link=stack[k - 1].link) if tag == "a" else o for o in stack[k + 1 :]]  # what was opened inside a link is not in it any more
                        stack[k:] = later
                        depth[tag] -= 1
                        inline -= 1
                        break
                    if stack[k].tag in BLOCK:
                        break
            elif tag not in VOID and not attributes.endswith("/"):
                if tag == "a" and depth.get("a"):  # links don't hold links
                    k = topmost("a")
                    later = [o._replace(link=False) for o in stack[k + 1 :]]
                    stack[k:] = later
                    depth["a"] -= 1
                    inline -= 1
                if inline < 512 or tag == "a":  # the inline elements of a page that never closes them say nothing new
                    push(_opened(tag, attributes, stack[-1], hints, closed))
                if tag == "a":
                    linked.append(" ")
        else:
            while stack[-1].tag in DROPPED_INLINE and not (tag == "div" and stack[-1].tag == "button") or stack[-1].tag not in OWN_BLOCKS:
                cut(len(stack) - 1)
            if not stack[-1].dropped:
                close()
            if tag in VOID or tag in PLAIN and tag != "body":
                continue
            if kind == "close":
                if depth.get(tag):
                    cut(topmost(tag))
            else:
                while stack[-1].tag in ("a", "p") or tag == "body" and len(stack) > 1:
                    cut(len(stack) - 1)
                if tag != "body":
                    push(_opened(tag, attributes, stack[-1], hints, closed))
                    heading = len(tag) == 2 and tag[0] == "h" and tag[1].isdigit()
    close()
    return _settled(out, hints)


def features_of(blocks: list[Block]) -> np.ndarray:
    words = np.array([b.words for b in blocks], float)
    links = np.array([b.link_words / b.words for b in blocks], float)
    around = [np.concatenate([[0.0], x[:-1]]) for x in (words, links)] + [np.concatenate([x[1:], [0.0]]) for x in (words, links)]
    flags = [np.array([getattr(b, name) for b in blocks], float) for name in ("article", "heading")]
    return np.stack([words, links, *around, *flags], axis=1)


#: The labelled table, a page a line: for each block its words, the words of them in links, a if it stands in an article, h if it is
#: a heading, and + for article text or - for other text. Page furniture that is marked as such counts as a neighbour only and has no label.
LABELLED = """
1/1- 1/1- 2/2- 2/2- 7/0h+ 64/0+ 112/3+ 41/0+ 8/0+ 95/0+ 9/4- 4/4- 3/3-
6/6- 5/0- 9/0h+ 120/0+ 14/0+ 88/2+ 230/0+ 3/3- 3/3- 5/5-
1/1 1/1 1/1 8/0ah+ 77/0a+ 2/0a+ 31/0a+ 140/0a+ 6/0
11/0ah+ 2/0a+ 5/0a+ 3/0a+ 1/0a+ 4/4a+ 60/0a+
2/0a+
5/5a+ 4/4a+ 88/4a+ 3/3a+
3/0ah+ 2/2a+ 2/2a+ 2/2a+ 35/0a+
12/12 40/0h 10/0ah+ 35/0a+ 9/9a+ 18/1a+ 22/0
2/0+
5/0+
14/0+ 3/0+
4/0h+ 9/0+
9/0+ 7/0+ 11/0+
6/0h+ 23/0+
31/0+
3/0h+ 2/0+ 4/0+ 2/0+
1/1- 2/2- 1/1- 3/0+ 55/0+ 4/0+ 62/0+ 7/7- 6/6- 8/8- 4/1-
1/1- 1/1- 18/0+ 21/0+ 12/0+ 2/2- 6/6-
2/2- 2/2- 2/2- 6/0h+ 25/0+ 28/5+ 24/0+ 9/2+ 33/0+ 1/1- 1/1-
8/8- 7/7- 9/9- 10/10- 8/8- 6/6-
3/3- 2/2- 3/3- 4/4- 2/2- 5/5-
10/9- 12/11- 8/7- 9/9- 2/1-
6/1- 4/3- 120/4+ 75/0+ 2/0+ 100/6+ 5/4- 2/2-
4/3- 3/2- 5/0h+ 52/0+ 44/0+ 38/0+ 12/11- 15/13- 3/1-
20/20- 25/22- 41/38- 6/0h+ 81/2+ 66/0+
5/0h+ 40/0+ 3/0h+ 44/0+ 6/0h+ 51/0+ 4/0h+ 39/0+ 8/0- 2/2- 2/2-
2/2- 4/0h+ 300/12+ 4/0h+ 260/0+ 5/0+ 6/0+ 4/0+ 180/0+ 3/3-
1/1- 1/1- 1/1- 1/1- 9/0+ 400/20+ 1/1- 1/1-
3/2- 2/1- 17/0+ 35/1+ 16/0+ 29/0+ 3/2- 2/2- 4/3-
12/0h+ 3/0+ 70/0+ 85/0+ 14/14- 11/11- 13/13- 12/12-
6/0h+ 10/0+ 12/0+ 9/0+ 2/0+ 8/0+ 11/0+
4/0+ 5/0+ 6/0+ 4/0+ 5/0+
3/3- 3/3- 45/0+ 1/0+ 2/0+ 48/0+ 3/3- 2/0-
2/2- 2/2- 2/0- 2/2- 2/2-
1/1- 2/0- 1/1- 3/0- 1/1- 30/0+ 42/0+
5/5- 1/0- 5/5- 70/0+ 1/0- 5/5-
2/2- 90/0+ 110/0+ 2/0- 3/3- 2/2-
"""


def labelled_blocks() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the table."""
    xs, ys = [], []
    for line in LABELLED.strip().split("\n"):
        cells = [re.fullmatch(r"(\d+)/(\d+)(a?)(h?)([+-]?)", cell) for cell in line.split()]
        blocks = [Block("", int(c[1]), int(c[2]), not c[5], bool(c[3]), bool(c[4])) for c in cells]
        own = np.array([bool(c[5]) for c in cells])
        xs.append(features_of(blocks)[own])
        ys.append(np.array([c[5] == "+" for c in cells], float)[own])
    return np.concatenate(xs), np.concatenate(ys)


class Tree(NamedTuple):
    """A binary tree in arrays; a leaf has feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    keep: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while (inner := self.feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            now = at[rows]
            at[rows] = np.where(x[rows, self.feature[now]] <= self.cut[now], self.left[now], self.right[now])
        return self.keep[at]


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Tree:
    """A decision tree by Gini impurity; ties go to the earlier split."""
    nodes: list[list[float]] = []

    def impurity(part: np.ndarray) -> float:
        p = part.mean() if len(part) else 0.0
        return 2 * p * (1 - p) * len(part)

    def grow(rows: np.ndarray, level: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, float(y[rows].mean() >= 0.5)])
        best = (impurity(y[rows]) - 1e-9, -1, 0.0)
        if level < depth:
            for f in reversed(range(x.shape[1])):
                values = np.unique(x[rows, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    go = x[rows, f] <= cut
                    left_over = impurity(y[rows[go]]) + impurity(y[rows[~go]])
                    if left_over < best[0] - 1e-9:
                        best = (left_over, f, float(cut))
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            nodes[me][:2] = [best[1], best[2]]
            nodes[me][2] = grow(rows[go], level + 1)
            nodes[me][3] = grow(rows[~go], level + 1)
        return me

    grow(np.arange(len(y)), 0)
    a = np.array(nodes)
    return Tree(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4] > 0)


@lru_cache(maxsize=1)
def default_tree() -> Tree:
    return fit_tree(*labelled_blocks())


def main_text(html: str | None, tree: Tree | None = None) -> str:
    """The article text of one page, its blocks joined by \\n; empty if there is none."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    kept = (tree or default_tree()).predict(features_of(blocks))
    return "\n".join(b.text for b, k in zip(blocks, kept) if k and not b.aside)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py()) for h in batch.column("_html")]
        rest = [(n, batch.column(i)) for i, n in enumerate(batch.schema.names) if n != "_html"]
        made = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + made, [*(n for n, _ in rest), "text", "n_chars"])


def extract_text(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns in keep, text and n_chars (code points) of every page, from its whole html.

    Null or empty html, and pages without an article, give an empty text. Repeated pages give repeated rows. An empty table gives an empty one. Columns of
    the page called text or n_chars are not read, whatever they hold; keep may not name them. A page of any length is read in time in proportion to
    it, and held in memory by one worker.
    """
    if {"text", "n_chars"} & set(keep):
        raise ValueError("text and n_chars are results; keep can't name them")
    slim = pages.select(*keep, F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(_extract, f"{fields}, text string, n_chars long")
