"""Main text of web pages by composite text density.

The page is parsed into a tree. The composite text density of a node is its characters per tag, adjusted by
the share of its links in characters and tags; its density sum is the sum over its children. The container
of the greatest density sum is the heart of the article, and its whole subtree is text. ``SLACK`` times the least density on
the path from body to the heart is the threshold: beside the path, a subtree is kept where it is a heading, and
where links are not most of it and its density reaches the threshold or the heart is next to it. So links
and scattered fragments outside the heart go, whatever their names, and all inside it, or inside an article
element around it, stays.

Element and class names only take away what is outside for certain (navigation, asides, footers, forms,
page headers, adverts, comments, notices); a name counts if each of its words says so or says nothing. Such
parts count as tags of what is around them, but their characters do not, and they are no candidates.

A page is one row and one task's work; nothing is shuffled. Defined results: null, empty and text-free
html give an empty text; broken markup (open tags, cut ends) is closed at the end; character references are
decoded; white space inside a block becomes one space, blocks are joined by a line feed; repeated rows
repeat; a null page_id or url stays null; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import map_arrow

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title".split())
ASIDE = frozenset("nav aside footer form button input select textarea label fieldset iframe object embed svg canvas audio video menu dialog map frameset".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"html", "body", "caption", "td", "th", "tr", "tbody", "thead", "tfoot"}
#: An opening tag ends these open elements, up to the scope on the right.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPES = frozenset("html body table td th caption".split())
#: What may be the heart: blocks that hold blocks.
CONTAINERS = BLOCKS - frozenset("p pre h1 h2 h3 h4 h5 h6 hr caption figcaption legend summary li dt dd".split())
# Words in class, id or role names of parts outside the article, and words that say nothing.
OUTSIDE = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies disqus footer gdpr login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion promoted recommendations recommended related replies reply respond search share sharing sidebar signup social sponsor "
    "sponsored subscribe subscription tagcloud teaser toolbar tooltip widget widgets".split()
)
NEUTRAL = frozenset("area article bar block bottom box button buttons container content entry form global group header inner item items left link links list main module outer page panel post posts primary reader right secondary section site slot thread top unit user wrap wrapper".split())
SLACK = 0.25
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "children", "outside", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, outside: bool = False):
        self.tag, self.outside, self.children = tag, outside, []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags, self.density, self.total = 1, 0.0, 0.0


def _names_outside(name: str) -> bool:
    """sidebar, post-comments, adSlot; but not has-sidebar or search-results-discussion, which say something else."""
    words = {w.lower() for w in _NAME.findall(name)}
    return bool(words & OUTSIDE) and words <= OUTSIDE | NEUTRAL


def _is_outside(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    if tag in ASIDE:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and _HIDDEN.search(value.lower())):
            return True
        if name in ("class", "id", "role") and value and any(map(_names_outside, value.split())):
            return True
    return False


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]

    def _end(self, names: set[str], scope: frozenset[str] | set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in names:
                del self.open[i:]
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.open):
            return
        if tag == "body":
            del self.open[1:]
        if tag in CLOSES_P:
            self._end({"p"}, SCOPES)
        if tag in ENDS:
            self._end(*ENDS[tag])
        node = Node(tag, _is_outside(tag, attrs))
        if tag not in UNSEEN:
            self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if tag not in ("html", "body"):
            self._end({tag}, frozenset() if tag in BLOCKS else SCOPES)

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def _bottom_up(root: Node) -> list[Node]:
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return order[::-1]


def measure(root: Node) -> None:
    """Characters, tags, links, densities and density sums of every node."""
    for node in _bottom_up(root):
        for child in node.children:
            if isinstance(child, Node):
                node.tags += child.tags
                if not child.outside:
                    node.chars += child.chars
                    node.link_chars += child.link_chars
                    node.link_tags += child.link_tags
            else:
                node.chars += len("".join(child.split()))
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    whole_links, whole = root.link_chars, max(1, root.chars)
    for node in _bottom_up(root):
        plain = max(1, node.chars - node.link_chars)
        if node.chars:
            base = math.log(node.chars / plain * node.link_chars + whole_links / whole * node.chars + math.e)
            share = node.chars / max(1, node.link_chars) * node.tags / max(1, node.link_tags)
            node.density = node.chars / node.tags * max(0.0, math.log(max(share, 1.0)) / base) if node.link_chars else node.chars / node.tags * max(1.0, math.log(max(node.chars * node.tags, 1)) / base)
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.outside)


def _parents(root: Node) -> dict[int, Node]:
    """The parent of each node that is not in an outside part; a header outside article and main is one."""
    parents, stack = {}, [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        for child in node.children:
            if isinstance(child, Node):
                child.outside = child.outside or child.tag == "header" and not inside
                if not child.outside:
                    parents[id(child)] = node
                    stack.append((child, inside))
    return parents


def article(root: Node) -> tuple[Node, set[int]]:
    """Where text is taken from, and the ids of nodes that are left out below it."""
    parents = _parents(root)
    measure(root)
    nodes = _bottom_up(root)[::-1]
    body = next((n for n in nodes if n.tag == "body"), root)
    able = [n for n in _bottom_up(body)[::-1] if n is body or n.tag in CONTAINERS and id(n) in parents]
    best = max(able, key=lambda n: (n.total, n.chars))
    path = [best]
    while path[-1] is not body:
        path.append(parents[id(path[-1])])
    threshold = SLACK * min(n.density for n in path)
    left_out = {id(n) for n in nodes if n.outside}
    for above, below in zip(path[1:], path[:-1], strict=True):
        if any(n.tag == "article" for n in path[path.index(above) :]):
            continue
        beside_heart = below is best and above is not body
        for child in above.children:
            if isinstance(child, Node) and child is not below and child.tag not in _HEADINGS:
                if 2 * child.link_chars > child.chars or child.density < threshold and not beside_heart:
                    left_out.add(id(child))
    return body, left_out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    start, left_out = article(parse(html))
    blocks: list[list[str]] = [[]]
    stack: list[Node | str | None] = [start]
    while stack:
        item = stack.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif id(item) in left_out:
            blocks[-1].append(" ")
        else:
            if item.tag == "br":
                blocks[-1].append(" ")
            block = item.tag in BLOCKS
            if block:
                blocks.append([])
                stack.append(None)
            stack.extend(reversed(item.children))
    lines = (" ".join("".join(b).split()) for b in blocks)
    return "\n".join(line for line in lines if line)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint")
