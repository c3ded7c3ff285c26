"""Main text of web pages by composite text density.

The page becomes a tree of block elements. Every node gets its characters per tag, adjusted for the share of link
characters and link tags; a node's density sum is the sum of its children's densities. The content is the node with
the largest density sum, or what holds it if that is a list, quotation or paragraph; nodes beside its path are content
too if they are as dense as the sparsest node of the path from the body, where links in a text of mostly plain words do
not count against it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from churnspark.llm.common import arrow_rows

# Element names of HTML by their part in the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
DROPPED = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head header iframe input map math menu nav "
    "noembed noframes noscript object option output progress script select style svg template textarea title video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Links that an element mostly made of links has at least if it is no part of an article.
LINKS = 4
#: Parts of an article that are never the whole of it.
TEXT_PARTS = frozenset("p ul ol dl li dt dd blockquote pre figure".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
CLOSES_SAME = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
# Words in class, id or role that mark what is not the article: always if they are the whole name, otherwise only for an
# element that is less than half as dense as the page or mostly links.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner popup modal "
    "overlay cookie cookies consent gdpr notice notices notification notifications alert nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar side aside footer header masthead topbar toolbar comment comments disqus reply "
    "replies respond responses discussion share sharing social related recommended recommendations newsletter subscribe "
    "subscription signup login search form widget pagination pager copyright legal disclaimer complementary contentinfo "
    "skip hidden commentlist commentform subnav topnav sidenav adbox adslot adunit leaderboard".split()
)
# Words that mark what is not the article as a part of a name as well.
CLEAR_MARKS = frozenset(
    "comment comments commentlist commentform disqus replies cookie cookies consent gdpr navbar sidebar breadcrumb breadcrumbs "
    "newsletter advert adverts advertisement advertising adsense sponsored masthead topbar toolbar pagination pager adbox "
    "adslot adunit leaderboard subnav topnav sidenav copyright disclaimer".split()
)
#: After one of these words a mark tells about the layout around the element, not about the element.
ABOUT = frozenset("has with no without".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "suspect", "chars", "tags", "link_chars", "link_tags", "density", "total", "own")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, suspect: bool = False):
        self.tag, self.parent, self.dropped, self.suspect, self.own = tag, parent, dropped, suspect, None
        self.parts: list = []  # texts and child nodes in page order
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def marked(attrs) -> tuple[bool, bool]:
    """Whether class, id, role or a hiding attribute says that the element is not part of the article, and whether a part
    of such a name suggests it."""
    suspect = False
    for name, value in attrs:
        if name in ("class", "id", "role") and value:
            for word in value.split():
                tokens = [t.lower() for t in _TOKEN.findall(word)]
                found = {t for before, t in zip(["", *tokens], tokens) if t in MARKS and before not in ABOUT}
                if found & CLEAR_MARKS or found and len(tokens) == 1:
                    return True, False
                suspect |= bool(found)
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, False
        if name == "style" and value and re.search(r"display\s*:\s*none", value, re.I):
            return True, False
    return False, suspect


class Tree(HTMLParser):
    """Block elements of one page; inline elements only leave their text and count as tags of their block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.node = Node("", None)
        self.body: Node | None = None
        self.links = 0
        self.skipped: list[str] = []  # open inline elements that are marked as not part of the article
        self.open: Counter[str] = Counter()  # open block elements by name

    def _leave(self, parent: Node) -> None:
        """Close blocks up to a node, which stays open."""
        while self.node is not parent:
            self.open[self.node.tag] -= 1
            self.node = self.node.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html" or tag == "body":
            if tag == "body" and self.body is None:
                while self.node.tag == "head":
                    self._leave(self.node.parent)
                self.body = self.node
            return
        if tag in INLINE:
            if tag == "a":
                self.links += 1
                self.node.link_tags += 1
            if tag == "br":
                self.node.parts.append(" ")
            elif tag not in VOID and (self.skipped or marked(attrs)[0]):
                self.skipped.append(tag)
            self.node.tags += 1
            return
        if tag in ENDS_PARAGRAPH:
            self._close({"p"}, ENDS_PARAGRAPH - {"p"})
        if tag in HEADINGS:
            self._close(HEADINGS, ENDS_PARAGRAPH - HEADINGS)
        if tag in CLOSES_SAME:
            self._close(*CLOSES_SAME[tag])
        if tag not in ("tr", "td", "th", "li", "dt", "dd", "option") and self.node.tag == "head" and tag not in DROPPED | VOID:
            self._leave(self.node.parent)
        dropped, suspect = marked(attrs) if tag not in ("article", "main") else (False, False)
        made = Node(tag, self.node, tag in DROPPED or dropped, suspect)
        made.tags = 1
        self.node.parts.append(made)
        if tag not in VOID:
            self.node = made
            self.open[tag] += 1
            self.links = 0
            self.skipped = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in INLINE - VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in INLINE:
            if tag == "a" and self.links:
                self.links -= 1
            if tag in self.skipped:
                del self.skipped[len(self.skipped) - 1 - self.skipped[::-1].index(tag) :]
            return
        if not self.open[tag]:
            return
        node = self.node
        while node is not None and node.tag != tag:
            if node.tag in ("article", "main") and tag in ("p", "li", "td", "th", "tr", "dd", "dt"):
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self._leave(node.parent)
            self.links = 0
            self.skipped = []

    def handle_data(self, data):
        if self.skipped:
            return
        node = self.node
        node.parts.append(data)
        n = len(data) - data.count(" ")
        node.chars += n
        if self.links:
            node.link_chars += n

    def _close(self, tags, fences):
        if not any(self.open[t] for t in tags):
            return
        node = self.node
        while node is not None and node.tag not in tags:
            if node.tag in fences or node.parent is None:
                return
            node = node.parent
        if node is not None and node.parent is not None:
            self._leave(node.parent)
            self.links = 0
            self.skipped = []


def _preorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [p for p in reversed(node.parts) if isinstance(p, Node) and not p.dropped]
    return out


def _ratio(body: Node) -> float:
    return body.link_chars / body.chars if body.chars else 0.0


def _density(c: int, t: int, lc: int, lt: int, ratio: float) -> float:
    """Composite text density of characters, tags, link characters and link tags."""
    if not c:
        return 0.0
    t = max(t, 1)
    base = math.log(c / max(c - lc, 1) * lc + ratio * c + math.e)
    spread = c / max(lc, 1) * t / max(lt, 1)
    return c / t * max(math.log(max(spread, 1.0)) / math.log(base) if base > 1.0 else math.log(max(spread, 1.0)), 0.0)


def _mostly_links(node: Node) -> bool:
    return 2 * node.link_chars > node.chars


def _weigh(nodes: list[Node], body: Node) -> None:
    """Composite density of every node: children first."""
    for node in nodes:
        node.own = node.own or (node.chars, node.tags, node.link_chars, node.link_tags)
        node.chars, node.tags, node.link_chars, node.link_tags = node.own
    for node in reversed(nodes):
        for part in node.parts:
            if isinstance(part, Node) and not part.dropped:
                node.chars += part.chars
                node.tags += part.tags
                node.link_chars += part.link_chars
                node.link_tags += part.link_tags
    for node in nodes:
        node.density = _density(node.chars, node.tags, node.link_chars, node.link_tags, _ratio(body))
    for node in nodes:
        node.total = sum(p.density for p in node.parts if isinstance(p, Node) and not p.dropped)


def _content(nodes: list[Node], body: Node) -> list[Node]:
    """Nodes whose whole text is content, in page order."""
    best = max(nodes, key=lambda n: n.total)  # the first of equals
    if not best.total:
        return [body]
    path, node = [], best
    while node is not None:
        path.append(node)
        if node is body:
            break
        node = node.parent
    threshold = min(n.density for n in path)
    for n in reversed(path):  # the outermost article or main element on the path holds the whole article
        if n.tag in ("article", "main"):
            path, best = path[path.index(n) :], n
            break
    ratio = _ratio(body)

    def passes(part: Node) -> bool:
        if not part.chars or not threshold > 0:
            return False
        if part.density >= threshold:
            return True
        plain = _density(part.chars - part.link_chars, part.tags - part.link_tags, 0, 0, ratio)
        return bool(part.link_chars) and not _mostly_links(part) and plain >= threshold

    grown = 0
    while path[grown].tag in TEXT_PARTS and path[grown] is not body:
        grown += 1
    if grown:
        # The part's siblings are parts of the same article, but for those of links and for sparse containers.
        inner, path = path[grown - 1], path[grown:]
        best = path[0]
        for part in best.parts:
            if isinstance(part, Node) and part is not inner and not part.dropped:
                part.dropped = _mostly_links(part) or part.tag not in TEXT_PARTS | HEADINGS | VOID and not passes(part)
    chosen, on_path = set(), set(map(id, path))
    for parent in path[1:]:
        beside = [p for p in parent.parts if isinstance(p, Node) and not p.dropped]
        here = next(i for i, p in enumerate(beside) if id(p) in on_path)
        for i, part in enumerate(beside):
            heading = i < here and part.tag in HEADINGS and part.chars and not part.link_chars
            if i != here and (heading or passes(part)):
                chosen.add(id(part))
    chosen.add(id(best))
    # A run of links is no part of an article, wherever it stands.
    for n in nodes:
        if n.link_tags >= LINKS and _mostly_links(n) and n.density < threshold and id(n) not in on_path:
            n.dropped = True
    return [n for n in nodes if id(n) in chosen and not n.dropped]


def _blocks(node: Node, out: list[str]) -> None:
    """Texts of the blocks below a node, in page order."""
    run: list[str] = []
    stack: list = [iter(node.parts)]
    while stack:
        for part in stack[-1]:
            if isinstance(part, str):
                run.append(part)
            elif not part.dropped:
                _flush(run, out)
                stack.append(iter(part.parts))
                break
        else:
            _flush(run, out)
            stack.pop()


def _flush(run: list[str], out: list[str]) -> None:
    text = " ".join("".join(run).split())
    run.clear()
    if text:
        out.append(text)


def main_text(html: str | None) -> str:
    """The article of one page: blocks joined by a newline; '' for null, empty or text-free pages."""
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    body = tree.body or tree.root
    nodes = _preorder(body)
    _weigh(nodes, body)
    doubtful = [n for n in nodes if n.suspect and (_mostly_links(n) or 2 * n.density < body.density)]
    if doubtful:
        for node in doubtful:
            node.dropped = True
        nodes = _preorder(body)
        _weigh(nodes, body)
    out: list[str] = []
    for node in _content(nodes, body):
        _blocks(node, out)
    return "\n".join(out)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row; the page is one task-local tree, nothing is shuffled.

    A null or empty page has an empty text; null ids and urls stay null; repeated rows stay. An empty table gives no rows.
    """
    pages = df.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html")
    )
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def rows(batches):
        for batch in batches:
            for page, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = main_text(html.as_py())
                yield page, url, text, len(text)

    return pages.mapInArrow(arrow_rows(schema, rows, 256), "page_id bigint, url string, text string, n_chars bigint")
