"""Main text of web pages by tree scoring.

A page is read once, left to right, into a tree and blocks of running text. Blocks pass
points for their length and commas to their ancestors, fewer with distance; a container's
points are discounted by the share of its text in links. The best container is kept with
the siblings that carry the same article. What an element's name, class or role says of it
is a mark, not a verdict: a weak mark gives way where the marked element holds more running
text than all that stands outside of it. Every step is linear in the page.
"""

from __future__ import annotations

import heapq
import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

#: How much of a mark an element bears: none, weak, strong, never text.
PLAIN, WEAK, STRONG, NEVER = range(4)
#: Elements that never hold article text, those that seldom do, and those that may wrap a page (fixed values).
NEVER_TEXT = frozenset("script style noscript template select option textarea input iframe object embed svg math canvas audio video map head title".split())
SELDOM = frozenset("nav footer aside button label dialog menu".split())
WRAPS = frozenset("form fieldset header".split())
#: Elements whose content is text up to their own end tag (fixed values).
RAW = frozenset("script style textarea title noscript iframe xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end a block of text on both sides (fixed values).
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr caption ul".split())
#: An open element of these is closed by the start of one of those (fixed values).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Parts of a class, id or role that name what surrounds an article (fixed values).
SURROUNDS = frozenset("ad ads advert adverts advertisement advertising adbox sponsored cookie cookies consent gdpr popup newsletter subscribe subscription signup paywall nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar toolbar comment comments commentlist respond reply replies disqus discussion pager pagination login complementary contentinfo".split())
#: Parts that do so often, but name subjects and layouts as well (fixed values).
PERHAPS = frozenset("banner sponsor promo promotion notice alert modal overlay side aside rail widget share sharing social related recommended recommendations trending popular search hidden".split())
#: Parts that tell the state of a page rather than what an element is (fixed values).
STATES = frozenset("has no not with without is on off open closed enabled disabled left right".split())
#: Least characters of running text by which an element without a heading shows to be an article.
ARTICLE_CHARS = 140
_SITE_HEADER = frozenset(("header", "site-header", "page-header"))
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>\"']*)|!--|!\[CDATA\[|[!?])")
_PLAIN_ATTR = re.compile(r"[^>\"']*")
_ATTR = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?=[\s/>]|$))", re.I)
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[-_]+")
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "block", "mark", "home", "in_home", "byline", "link", "points", "chars", "linked", "running", "signs", "kept", "inline")

    def __init__(self, tag: str, parent):
        self.tag, self.parent, self.block = tag, parent, tag in BLOCK
        self.mark, self.home, self.inline = PLAIN, False, {}
        self.in_home = parent is not None and (parent.in_home or parent.home)
        self.byline = parent is not None and parent.byline
        self.link = tag == "a" or parent is not None and parent.link
        self.points, self.chars, self.linked, self.running, self.signs, self.kept = 0.0, 0, 0, 0, 0, False


def _named(value: str) -> int:
    """The mark of a class, an id or a role."""
    out = PLAIN
    for name in value.lower().split():
        parts = set(_PARTS.split(name))
        if parts & SURROUNDS:
            out = max(out, WEAK if parts & STATES else STRONG)
        elif parts & PERHAPS:
            out = max(out, WEAK)
    return out


def _judge(node: Node, attrs: str) -> None:
    tag = node.tag
    node.home = tag in ("article", "main")
    if tag in NEVER_TEXT:
        node.mark = NEVER
        return
    node.mark = STRONG if tag in SELDOM else WEAK if tag in WRAPS else PLAIN
    if tag == "header" and node.in_home:
        node.mark, node.byline = PLAIN, True
    if not attrs or tag in ("html", "body"):
        return
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id", "role"):
            if name == "role" and value.lower() in ("main", "article") or name != "role" and value == "articleBody":
                node.home = True
            mark = _named(value)
            if node.home and not re.search("comment|repl", value, re.I):
                mark = PLAIN
            if tag == "div" and _SITE_HEADER & set(value.lower().split()):
                if node.in_home:
                    node.byline = True
                else:
                    mark = max(mark, WEAK)
            node.mark = max(node.mark, mark)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _HIDES.search(value):
            node.mark = NEVER
        elif name == "itemprop" and value == "articleBody":
            node.home = True


class Page:
    """Nodes in the order of their start, and blocks: lists of (node, text) in page order."""

    def __init__(self, page: str):
        self.root = Node("#root", None)
        self.nodes = [self.root]
        self.blocks: list[list[tuple[Node, str]]] = []
        self._own: list[tuple[Node, str]] = []
        self._stack = [self.root]
        self._around = [self.root]  # open block elements
        self._open: dict[str, int] = {}  # open block elements by name
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if self._own:
            self.blocks.append(self._own)
            self._own = []

    def _text(self, text: str) -> None:
        node = self._stack[-1]
        if text and node.mark != NEVER:
            self._own.append((node, html.unescape(text) if "&" in text else text))

    def _pop(self) -> Node:
        node = self._stack.pop()
        if node.block:
            self._flush()
            self._around.pop()
            self._open[node.tag] -= 1
        else:
            self._around[-1].inline[node.tag] -= 1
        return node

    def _until(self, tag: str) -> None:
        """Closes elements up to and with the innermost of this name."""
        while self._pop().tag != tag:
            pass

    def _start(self, tag: str, attrs: str) -> None:
        top = self._around[-1]
        if tag in BLOCK:
            # A paragraph ends where a block begins, and so do inline elements that were left open in it.
            if top.tag == "p" or top.tag in HEADINGS and tag in HEADINGS:
                self._until(top.tag)
            closed = CLOSES.get(tag, ())
            while self._around[-1].tag in closed:
                self._until(self._around[-1].tag)
            self._flush()
        elif tag in ("a", "option") and top.inline.get(tag):
            self._until(tag)
        node = Node(tag, self._stack[-1])
        _judge(node, attrs)
        if node.parent.mark == NEVER:
            node.mark = NEVER
        self.nodes.append(node)
        if tag in VOID or attrs.rstrip().endswith("/"):
            return
        self._stack.append(node)
        if node.block:
            self._around.append(node)
            self._open[tag] = self._open.get(tag, 0) + 1
        else:
            top = self._around[-1].inline
            top[tag] = top.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if tag in BLOCK and self._open.get(tag) or self._around[-1].inline.get(tag):
            self._until(tag)
        elif tag == "p":
            self._flush()

    def _read(self, page: str) -> None:
        at, last, quotes = 0, page.rfind(">"), True
        while True:
            m = _TAG.search(page, at)
            if not m:
                self._text(page[at:])
                return
            self._text(page[at : m.start()])
            if m.start() > last and m[2] is not None:
                return  # a tag that never ends takes the rest of the page with it
            if m[2] is None:
                close = {"<!--": "-->", "<![CDATA[": "]]>"}.get(m[0], ">")
                end = page.find(close, m.end())
                if m[0] == "<![CDATA[" and self._stack[-1].mark != NEVER:
                    self._own.append((self._stack[-1], page[m.end() : end if end >= 0 else None]))
                if end < 0:
                    return
                at = end + len(close)
                continue
            end = m.end()
            # Behind a quote that nothing closes, no quote counts any more: tags end at the first ``>``.
            while quotes and end < len(page) and page[end] != ">":
                there = page.find(page[end], end + 1)
                if there < 0:
                    quotes = False
                else:
                    end = _PLAIN_ATTR.match(page, there + 1).end()
            if not quotes or end >= len(page):
                quotes, end = False, page.find(">", m.end())
            tag = m[2].lower()
            at = end + 1
            if m[1]:
                self._end(tag)
                continue
            self._start(tag, page[m.end(2) : end])
            if tag == "br":
                self._text(" ")
            elif tag in RAW:
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                if not stop:
                    return
                at = stop.start()


def _sums(page: Page, blocks: list) -> None:
    """Characters, those in links, and running text of each node with all below it. A marked
    element's running text is its own and doesn't count for what is around it."""
    for node in page.nodes:
        node.chars = node.linked = node.running = node.signs = 0
    for block in blocks:
        for node, text in block:
            n = len(text)
            node.chars += n
            if node.link:
                node.linked += n
            elif node.tag not in HEADINGS:
                node.running += n
    for node in reversed(page.nodes):
        up = node.parent
        if up is None:
            continue
        up.chars += node.chars
        up.linked += node.linked
        if node.mark == PLAIN:
            up.running += node.running
            up.signs |= node.signs
        if node.chars and node.mark != NEVER:
            up.signs |= 2 if node.home else 1 if node.tag in HEADINGS else 0


def _clear_marks(page: Page) -> None:
    """Takes the marks off elements that are the article's wrapper by all that they hold."""
    inside: dict[int, list[Node]] = {}
    top: dict[int, Node] = {}  # node to the marked element around it
    for node in page.nodes[1:]:
        over = node.parent if node.parent.mark != PLAIN else top.get(id(node.parent))
        if over is not None:
            top[id(node)] = over
        if node.mark in (WEAK, STRONG):
            inside.setdefault(id(over), []).append(node)
    outside, homes = page.root.running, page.root.signs & 2
    order = {id(n): i for i, n in enumerate(page.nodes)}
    heap = [(-n.running, order[id(n)], n) for n in inside.get(id(None), ())]
    heapq.heapify(heap)
    while heap:
        running, _, node = heapq.heappop(heap)
        home = node.signs & 2 and not homes
        article = node.signs or -running >= ARTICLE_CHARS
        if not (home and 4 * -running > outside or node.mark == WEAK and article and -running > outside):
            # Nothing of its own, but perhaps a wrapper of wrappers.
            if node.mark != WEAK or running or outside:
                continue
        node.mark = PLAIN
        outside, homes = outside - running, homes | node.signs & 2
        for n in inside.get(id(node), ()):
            heapq.heappush(heap, (-n.running, order[id(n)], n))


def _value(n: Node) -> float:
    return n.points * (1 - min(1.0, n.linked / max(1, n.chars)))


def _block_of(node: Node) -> Node:
    while not node.block and node.parent is not None:
        node = node.parent
    return node


def extract(text: str | None) -> str:
    """The article's blocks, joined by one line feed; empty if there is none."""
    if not text:
        return ""
    page = Page(text)
    _sums(page, page.blocks)
    _clear_marks(page)
    for node in page.nodes[1:]:
        if node.parent.mark != PLAIN:
            node.mark = NEVER
    found: list[tuple[Node, str, list]] = []
    for block in page.blocks:
        left = [(n, t) for n, t in block if n.mark == PLAIN]
        joined = _SPACE.sub(" ", "".join(t for _, t in left)).strip()
        if joined:
            # Of a header within an article, only headings are the article's.
            node = _block_of(left[0][0])
            if not node.byline or node.tag in HEADINGS:
                found.append((node, joined, left))
    if not found:
        return ""
    _sums(page, [left for _, _, left in found])
    scored: dict[int, Node] = {}
    for node, joined, _ in found:
        if node.tag in HEADINGS:
            continue
        points = 1 + joined.count(",") + joined.count("、") + joined.count("，") + min(len(joined) / 100, 3)
        # A bare text is a paragraph of its own element.
        up = node.parent if node.tag not in ("div", "section", "article", "main", "body") and node.parent is not None else node
        for depth in range(1, 6):
            if up is None or up.parent is None:
                break
            up.points += points / depth
            scored[id(up)] = up
            up = up.parent
    if not scored:
        return "\n".join(t for _, t, _ in found)
    best = max(scored.values(), key=lambda n: _value(n) * (0.5 if n.tag in ("html", "body") else 1))
    # The article that holds the best container is the container.
    up = best
    while up is not None:
        if up.home:
            best = up
        up = up.parent
    best.kept = True
    least = max(10.0, _value(best) * 0.2)
    for other in page.nodes:
        if other.parent is not best.parent or other is best or other.mark != PLAIN or other.parent is None:
            continue
        if best.home:
            other.kept = other.home or other.tag in HEADINGS
        else:
            few = other.linked < 0.25 * max(1, other.chars)
            other.kept = other.tag in HEADINGS or _value(other) >= least or other.tag == "p" and few and other.chars > 0
    for node in page.nodes[1:]:
        node.kept = node.kept or node.parent.kept
    return "\n".join(t for node, t, _ in found if node.kept)


def _extract(batches):
    for batch in batches:
        texts = [extract(x) for x in batch["html"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row of `pages`.

    Character references are decoded, white space in a block is one space, blocks are
    trimmed and joined in page order. A null or empty page, and one that is all
    surroundings, has an empty text. Tags that aren't closed end with what is around
    them; a tag without its ``>`` takes the rest of the page, as browsers have it. Very long
    and very deep pages take time in proportion to their length. Of containers with equal
    points the first wins. Rows that repeat and null ids come back as they are; other
    columns are ignored.
    """
    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in ("page_id", "url"))
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"{kinds}, text string, n_chars long")


def op9(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
