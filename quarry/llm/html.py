"""HTML extraction by composite text density.

For every node of the document tree: characters per tag, weighed down as links hold more of its text. A node's
density sum is the sum over its children, and the subtree of the greatest sum is the article. Its threshold is the
least density on its path up to the body, and blocks beside that path that reach it belong to the article too; within
an ``article`` element the whole element does.

Names are a penalty, no verdict: an element whose tag, class, id or role says that it is something else (a menu,
advert, sidebar, comment and so on) counts a tenth in the sums of its parents, one that merely mentions such a word
(``with-sidebar``, ``ad-free``) a half, and one named by class that holds the page's ``h1`` or ``main`` counts in full. What lies on the path to the greatest sum is never cut; other elements with the full penalty are.
Only what is no text of the page in any case (scripts, styles, controls, hidden elements) leaves the tree before.

Defined results: a null or empty page, and one without text in its body, gives an empty text; unclosed and misnested
tags are closed as browsers do for paragraphs, lists and tables; of equal sums the first wins; equal rows get equal
texts; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template button select textarea input label svg canvas iframe object title xmp noembed noframes option".split())
#: Elements that stand beside an article by their tag.
BESIDE = frozenset("nav aside footer form dialog menu".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"}
#: A start tag ends an open element of these kinds, unless one of the second kinds is nearer.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
#: Words of a class, id or role that name a part as no article.
NO_ARTICLE = frozenset(
    """ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget widgets menu nav navbar
    navigation breadcrumb breadcrumbs pagination pager footer contentinfo complementary search searchbox cookie cookies consent gdpr notice
    notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended
    comment comments commentlist respond disqus reply replies toolbar masthead skip""".split()
)
#: Words that, after such a word, still name the part itself: ``comment-list``.
PARTS = frozenset(
    """list section form box area wrap wrapper container block link links button buttons bar posts post item items thread feed panel icon icons cta
    message text body content inner holder slot unit zone strip group""".split()
)
#: Words that make a name a remark on something else: ``with-sidebar``.
REMARKS = frozenset("with without has have no not non is are hide hidden show free by off on open closed enabled disabled".split())
#: What an element counts in its parents' sums if it is named, or only mentions such a name.
NAMED, MENTIONED = 0.1, 0.5

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true)""", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Node:
    """An element: its tag, attributes, parent, and texts and elements within."""

    __slots__ = ("attrs", "children", "chars", "density", "holds", "links", "link_tags", "parent", "tag", "tags", "total", "weight")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.chars = self.links = self.tags = self.link_tags = 0
        self.density = self.total = 0.0
        self.weight, self.holds = 1.0, False


class _Open:
    """The open elements, found by tag without a walk."""

    def __init__(self, root: Node) -> None:
        self.stack = [root]
        self.by_tag: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, node: Node) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.by_tag.setdefault(node.tag, []).append(at)
        if node.tag in BLOCK:
            self.blocks.append(at)

    def close(self, at: int) -> None:
        """Close the element at a place and all within it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.by_tag[node.tag].pop()
            if node.tag in BLOCK:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """Place of the innermost open element of a tag, 0 if there is none."""
        places = self.by_tag.get(tag)
        return places[-1] if places else 0

    def first_after(self, tag: str, at: int) -> int:
        """Place of the outermost open element of a tag within the one at a place, 0 if there is none."""
        places = self.by_tag.get(tag, ())
        k = bisect_right(places, at)
        return places[k] if k < len(places) else 0


def parse(page: str) -> list[Node]:
    """All elements in page order, under a root without a tag, in time linear in the page."""
    root = Node("", "", None)
    opened = _Open(root)
    nodes, at, end = [root], 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            opened.stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            opened.stack[-1].children.append(page[at : m.start()])
        at = m.end()
        close, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            place = opened.last(tag)
            if place and (tag in BLOCK or not opened.blocks or place > opened.blocks[-1]):
                opened.close(place)
            continue
        if tag in CLOSES_P and opened.blocks and opened.stack[opened.blocks[-1]].tag == "p":
            opened.close(opened.blocks[-1])
        if tag in IMPLIED:
            ends, stops = IMPLIED[tag]
            stop = max((opened.last(t) for t in stops), default=0)
            if found := [x for t in ends if (x := opened.first_after(t, stop))]:
                opened.close(min(found))
        top = opened.stack[-1]
        node = Node(tag, attrs, top)
        top.children.append(node)
        nodes.append(node)
        if tag in RAW:
            m = _RAW_END[tag].search(page, at)
            at = m.start() if m else end
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            opened.push(node)
    return nodes


_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def named(attrs: str) -> float:
    """What the class, id and role of an element say it counts."""
    out = 1.0
    for m in _NAMES.finditer(attrs):
        for token in m[1].strip("\"'").lower().split():
            words = [w for w in _SPLIT.split(token) if w]
            if NO_ARTICLE.isdisjoint(words):
                continue
            if not REMARKS.isdisjoint(words) or not (words[-1] in NO_ARTICLE or words[-1] in PARTS):
                out = min(out, MENTIONED)
            else:
                out = NAMED
    return out


def weigh(nodes: list[Node]) -> None:
    """What each element counts for its tag and names; nodes are in page order."""
    inside: set[int] = set()
    for x in nodes:
        if x.parent is not None and (x.parent.tag in ("article", "main") or id(x.parent) in inside):
            inside.add(id(x))
        if x.tag in BESIDE or (x.tag == "header" and id(x) not in inside):
            x.weight = NAMED
        elif x.attrs and x.tag not in ("html", "body", "main"):
            x.weight = named(x.attrs)
        x.holds = x.tag in ("h1", "main")
    for x in reversed(nodes):
        if x.holds and x.tag not in BESIDE - {"form"} and x.tag != "header":
            x.weight = 1.0
            if x.parent is not None:
                x.parent.holds = True


def measure(nodes: list[Node]) -> None:
    """Sizes, composite densities and weighed density sums of a tree's nodes, given in page order.

    Denominators of 0 count as 1, and an element that is all links has density 0.
    """
    for x in nodes:
        x.chars = sum(len(c.strip()) for c in x.children if isinstance(c, str))
        x.links = x.tags = x.link_tags = 0
        x.total = x.density = 0.0
    for x in reversed(nodes):
        if x.tag == "a":
            x.links, x.link_tags = x.chars, x.tags + 1
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags + 1
            p.links += x.links
            p.link_tags += x.link_tags
    whole = nodes[0]
    share = whole.links / max(1, whole.chars)
    for x in reversed(nodes):
        if x.chars:
            links, link_tags, tags = max(1, x.links), max(1, x.link_tags), max(1, x.tags)
            base = math.log(x.chars / max(1, x.chars - x.links) * links + share * x.chars + math.e)
            x.density = max(0.0, x.chars / tags * math.log(x.chars / links * tags / link_tags) / math.log(base))
    factor = {}
    for x in nodes:
        factor[id(x)] = x.weight * (factor[id(x.parent)] if x.parent is not None else 1.0)
        if x.parent is not None:
            x.parent.total += x.density * factor[id(x)]


def _without(nodes: list[Node], cut) -> list[Node]:
    """Nodes in page order without those that ``cut`` names and all within them; these leave their parents' children."""
    gone: set[int] = set()
    out = []
    for x in nodes:
        if x.parent is not None and (id(x.parent) in gone or cut(x)):
            gone.add(id(x))
        else:
            out.append(x)
    if gone:
        for x in out:
            if any(not isinstance(c, str) and id(c) in gone for c in x.children):
                # what was cut still parts the text around it, if it is a block
                x.children = [c if isinstance(c, str) or id(c) not in gone else ("\0" if c.tag in BLOCK else " ") for c in x.children]
    return out


def densest(nodes: list[Node]) -> Node:
    """The node of the greatest density sum, the first of equal ones; the root if no element has text."""
    best = max(nodes, key=lambda x: x.total)
    return best if best.total else nodes[0]


def content(nodes: list[Node]) -> list[Node]:
    """The article's subtrees in page order, of the elements that may hold text."""
    weigh(nodes)
    measure(nodes)
    best = densest(nodes)
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    on_path = {id(x) for x in path}
    nodes = _without(nodes, lambda x: x.weight == NAMED and id(x) not in on_path)
    measure(nodes)
    article = next((x for x in reversed(path) if x.tag == "article"), None) or next((x for x in path if x.tag == "main"), None)
    if article is not None:
        return [article]
    threshold = min(x.density for x in path)
    chosen = {id(best)}
    for x in path[1:]:
        chosen |= {id(c) for c in x.children if not isinstance(c, str) and c.density >= threshold and c.tag in BLOCK and id(c) not in on_path}
    return [x for x in nodes if id(x) in chosen]


def blocks(node: Node) -> Iterator[str]:
    """Texts of a subtree's blocks."""
    held: list[str] = []
    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x == "\0":
                x = None
            else:
                held.append(unescape(x) if "&" in x else x)
                continue
        if x is None or x.tag in BLOCK:
            if text := " ".join("".join(held).split()):
                yield text
            held = []
        if x is not None:
            if x.tag == "br":
                held.append(" ")
            if x.tag in BLOCK:
                todo.append(None)
            todo += reversed(x.children)
    if text := " ".join("".join(held).split()):
        yield text


def body_of(page: str) -> list[Node]:
    """The body's nodes in page order, without what is no text of the page in any case."""
    nodes = parse(page.replace("\0", " "))
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    inside = {id(body)}
    kept = []
    for x in nodes:
        if x is body or (x.parent is not None and id(x.parent) in inside):
            inside.add(id(x))
            kept.append(x)
    body.parent = None
    return _without(kept, lambda x: x.tag in DROPPED or (x.attrs and x.tag not in ("html", "body") and _HIDDEN.search(x.attrs)))


def extract(page: str | None) -> str:
    """The article's text of one page."""
    if not page:
        return ""
    return "\n\n".join(text for x in content(body_of(page)) for text in blocks(x))


SCHEMA = "page_id long, url string, text string, n_chars long"


def articles(pages: DataFrame) -> DataFrame:
    """One row of SCHEMA for each page."""
    batches(pages.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [extract(page) for page in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [x.split()[0] for x in SCHEMA.split(", ")])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, SCHEMA)
