"""Markup that expressions cannot match: HTML as a tree, tables as grids, wiki text as plain text.

Each function here reads one text at a time, in time linear in its length, and is given to Spark as an Arrow function of
a column; what is done with the records is left to joins and aggregates. Null texts are empty ones.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspark.sources.tables import bounded_batches

# Headings of an infobox and the fields they fill.
FIELDS = {
    "japanese name": "name_ja", "romanized name": "name_romaji", "user": "owner", "namesake": "reference", "type": "stand_type", "origin": "origin",
    "awakening": "awakening", "manga debut": "manga_debut", "anime debut": "anime_debut", "first named": "first_named", "rush attack": "rush_attack",
}
# Notes of a wiki's editors inside headings.
HEADING_NOISE = ("citation", "without a citation", "not confirmed")
# Sources of an infobox' cells and their dimensions; titles of such cells.
DIMS = {"destpower": "PWR", "speed": "SPD", "range": "RNG", "stamina": "STA", "precision": "PRC", "potential": "DEV"}
DIM_TITLES = ("Destructive Power", "Speed", "Range", "Stamina", "Precision", "Potential")
#: Dimensions that the last group needs, characters of a scalar field at most.
LEAST_DIMS, FIELD_CHARS = 4, 400

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes open ones of the second kind, up to the third.
_CLOSES = {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "li": ({"li"}, {"ul", "ol"})}
_CLOSES |= dict.fromkeys("p div ul ol table section article aside form nav footer header h1 h2 h3 h4 h5 h6".split(), ({"p"}, {"div", "td", "th", "li", "section", "article"}))


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self) -> Iterator[Node | str]:
        """Nodes and texts below, in document order."""
        stack: list[Node | str] = self.children[::-1]
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(x.children[::-1])

    def all(self, *tags: str) -> Iterator[Node]:
        return (x for x in self.walk() if isinstance(x, Node) and x.tag in tags)

    def text(self, br: str = "", without: tuple[str, ...] = ()) -> str:
        """The text below; each <br> as ``br``, elements of ``without`` left out."""
        out: list[str] = []
        stack: list[Node | str] = self.children[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag == "br":
                out.append(br)
            elif x.tag not in without:
                stack.extend(x.children[::-1])
        return "".join(out)

    def classes(self) -> str:
        return self.attrs.get("class", "")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tags: set[str], fence: set[str]) -> None:
        node: Node | None = self.at
        while node is not None and node.tag not in tags and node.tag not in fence:
            node = node.parent
        if node is not None and node.parent is not None and node.tag in tags:
            self.at = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        node = Node(tag, {k: v or "" for k, v in attrs[::-1]}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs[::-1]}, self.at))

    def handle_endtag(self, tag: str) -> None:
        if tag not in _VOID:
            self._close({tag}, set() if tag == "table" else {"table"})

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


#: A tag with quoted attributes and nothing to resolve, or a text without references.
_SIMPLE = re.compile(r'<(/?)([A-Za-z][A-Za-z0-9]*)((?:[ \t\r\n\f]+[A-Za-z][A-Za-z0-9_-]*="[^"<>&]*")*)[ \t\r\n\f]*>|([^<&]+)')
_ATTRIBUTE = re.compile(r'([A-Za-z][A-Za-z0-9_-]*)="([^"]*)"')
#: Elements whose text is no markup.
_RAW = frozenset("script style textarea title iframe xmp noembed noframes noscript plaintext".split())


def _simple(html: str) -> list[tuple[str, str, str, str]] | None:
    """Tags and texts of a page that holds nothing else, else None."""
    found, at = [], 0
    for m in _SIMPLE.finditer(html):
        end, tag, attrs, _ = token = m.groups("")
        if m.start() != at or tag.lower() in _RAW or (end and attrs):
            return None
        found.append(token)
        at = m.end()
    return found if at == len(html) else None


def tree(html: str | None) -> Node:
    """The elements of a page. What is not closed ends with what holds it; a stray end tag is nothing. Pages of plain tags
    and texts are cut by one expression, others read by the parser of the standard library, with the same outcome."""
    builder, plain = _Builder(), _simple(html or "")
    if plain is None:
        builder.feed(html or "")
        builder.close()
        return builder.root
    for end, tag, attrs, text in plain:
        if text:
            builder.at.children.append(text)
        elif end:
            builder.handle_endtag(tag.lower())
        else:
            builder.handle_starttag(tag.lower(), [(k.lower(), v) for k, v in _ATTRIBUTE.findall(attrs)] if attrs else [])
    return builder.root


_MARK = re.compile(r"\[[0-9]+\]|\[[a-z]\]")


def clean(text: str) -> str:
    """Compatibility forms, footnote marks such as [12] and [a] gone, single spaces."""
    flat = " ".join((text if text.isascii() else unicodedata.normalize("NFKC", text)).split())
    return " ".join(_MARK.sub("", flat).split()) if "[" in flat else flat


def infobox(html: str | None) -> dict:
    """name, fields, forms (label, values): the fields named by <h3> and the element behind it, and the cells of six
    dimensions in groups. A dimension that comes again opens the next group; the last group counts only with
    LEAST_DIMS dimensions. A group's label is the first title in the section of its number."""
    root = tree(html)
    heads = [x for h in root.all("h1") for x in h.walk() if isinstance(x, str)]
    out: dict = {"name": clean(heads[0]) if heads else "", "fields": {}, "forms": []}
    for head in root.all("h3"):
        label = clean(head.text()).lower()
        for noise in HEADING_NOISE:
            label = label.split(noise)[0].strip()
        field, beside = FIELDS.get(label), head.parent.children if head.parent else []
        if field is None or field in out["fields"]:
            continue
        following = next((x for x in beside[_place(beside, head) + 1 :] if isinstance(x, Node)), None)
        if following is not None and 0 < len(clean(following.text())) < FIELD_CHARS:
            out["fields"][field] = clean(following.text(br=", "))
    groups: list[dict[str, str]] = [{}]
    for cell in root.all("td"):
        dim, value = DIMS.get(cell.attrs.get("data-source", "")), clean(cell.text())
        if dim is None or not value or "pi-data-value" not in cell.classes():
            continue
        if dim in groups[-1]:
            groups.append({})
        groups[-1][dim] = value
    if len(groups[-1]) < LEAST_DIMS:
        groups.pop()
    titles = []
    for section in root.all("section"):
        if "pi-group" in section.classes():
            first = next((h for h in section.all("th") if "pi-data-label" not in h.classes()), None)
            title = clean(first.text()) if first is not None else ""
            titles.append("" if title in DIM_TITLES else title)
    out["forms"] = [{"label": (titles[i : i + 1] or [""])[0] or f"form_{i}", "values": g} for i, g in enumerate(groups)]
    return out


def _place(beside: list, node: Node) -> int:
    return next(i for i, x in enumerate(beside) if x is node)


def grids(html: str | None, spans: bool = True) -> list[list[list[str]]]:
    """Every table, in document order, as rows of cell texts: a cell of several rows or columns fills each of its
    places, and what no cell covers is empty. A table inside a cell is a table of its own, and no part of the cell's
    text. Spans are read up to 1,000, and rows reach no further than their table. Without ``spans`` rows are their own
    cells alone."""
    out = []
    for table in tree(html).all("table"):
        rows, waiting, stack = [], {}, table.children[::-1]
        trs = []
        while stack:
            x = stack.pop()
            if isinstance(x, Node) and x.tag == "tr":
                trs.append(x)
            elif isinstance(x, Node) and x.tag in ("thead", "tbody", "tfoot"):
                stack.extend(x.children[::-1])
        for tr in trs:
            row: dict[int, str] = {c: text for c, (text, left) in waiting.items() if left}
            waiting = {c: (text, left - 1) for c, (text, left) in waiting.items() if left}
            column = 0
            for cell in (c for c in tr.children if isinstance(c, Node) and c.tag in ("td", "th")):
                text = clean(cell.text(br=" ", without=("table",)))
                while column in row:
                    column += 1
                for _ in range(_span(cell, "colspan") if spans else 1):
                    row[column] = text
                    waiting[column] = (text, _span(cell, "rowspan") - 1 if spans else 0)
                    column += 1
            rows.append([row.get(c, "") for c in range(max(row, default=-1) + 1)])
        out.append(rows)
    return out


def _span(cell: Node, name: str) -> int:
    given = cell.attrs.get(name, "").strip()
    return min(max(int(given), 1), 1000) if given.isascii() and given.isdigit() and len(given) < 9 else 1


def rendered(html: str | None) -> dict:
    """name, overview, sections (heading, paras, lists): paragraphs before the first heading below <h1>, then each heading
    with the paragraphs and lists up to the next. Navigation, scripts, styles and footers are not read."""
    root = tree(html)
    out: dict = {"name": "", "overview": [], "sections": []}
    stack: list[Node | str] = root.children[::-1]
    while stack:
        x = stack.pop()
        if isinstance(x, str) or x.tag in ("head", "script", "style", "nav", "footer", "aside", "form"):
            continue
        if x.tag == "h1":
            out["name"] = out["name"] or clean(x.text(br=" "))
        elif x.tag in ("h2", "h3", "h4", "h5", "h6"):
            out["sections"].append({"heading": clean(x.text(br=" ")), "paras": [], "lists": []})
        elif x.tag == "p":
            inner = [c for c in x.all("p")]
            text = clean(x.text(br=" ", without=("p",)))
            if text:
                (out["sections"][-1]["paras"] if out["sections"] else out["overview"]).append(text)
            stack.extend(inner[::-1] if inner else [])
        elif x.tag in ("ul", "ol"):
            items = [clean(li.text(br=" ")) for li in x.children if isinstance(li, Node) and li.tag == "li"]
            if out["sections"] and any(items):
                out["sections"][-1]["lists"].append([i for i in items if i])
        else:
            stack.extend(x.children[::-1])
    return out


# Templates whose first argument is part of the text; elements that go with what they hold.
KEPT_TEMPLATES = frozenset({"nihongo", "nihongo2", "ruby", "ruby2", "lang"})
DROPPED_ELEMENTS = ("gallery", "tabber", "tabview", "imagemap", "timeline")


def without_spans(text: str, opening: re.Pattern, closing: str) -> str:
    """text without what stands from each ``opening`` to the next ``closing``; an opening that is never closed stays."""
    low, out, at, close = text.lower(), [], 0, closing.lower()
    for found in opening.finditer(text):
        if found.start() < at:
            continue
        end = low.find(close, found.end())
        if end < 0:
            break
        out.append(text[at : found.start()])
        at = end + len(close)
    return "".join([*out, text[at:]])


def rewritten_templates(text: str) -> str:
    """Templates from the innermost outwards: the name decides whether the first argument stays in its place or nothing
    does. Braces are held on a stack; a template that never closes loses all that follows it."""
    held: list[list[str]] = [[]]
    for token in re.split(r"(\{\{|\}\}|\|)", text):
        if token == "{{":
            held.append([""])
        elif token == "}}" and len(held) > 1:
            name, *arguments = held.pop()
            value = arguments[0].strip() if name.strip().lower() in KEPT_TEMPLATES and arguments else ""
            _say(held, value)
        elif token == "|" and len(held) > 1:
            held[-1].append("")
        else:
            _say(held, token)
    return "".join(held[0])


def _say(held: list[list[str]], text: str) -> None:
    if len(held) == 1:
        held[0].append(text)
    elif len(held[-1]) <= 2:  # the name and the first argument are all that is ever read
        held[-1][-1] += text


def without_depth(text: str, opening: str, closing: str) -> str:
    """text outside of pairs, counted by depth; what never closes goes to the end, a stray closing mark stays."""
    out, depth = [], 0
    for token in re.split(f"({re.escape(opening)}|{re.escape(closing)})", text):
        if token == opening:
            depth += 1
        elif token == closing and depth:
            depth -= 1
        elif not depth:
            out.append(token)
    return "".join(out)


def linked_text(text: str) -> str:
    """[[target|shown]] as shown, [[target]] as target, files and images as nothing, [http://... shown] as shown."""
    out, at = [], 0
    for found in re.finditer(r"\[\[([^\[\]]*)\]\]|\[https?://([^\s\[\]]+)([^\[\]]*)\]", text):
        out.append(text[at : found.start()])
        if found[1] is None:
            out.append(found[3].strip())
        elif found[1].partition(":")[0].strip().lower() not in ("file", "image", "media") or ":" not in found[1]:
            out.append(found[1].partition("|")[2] if "|" in found[1] else found[1])
        at = found.end()
    return "".join([*out, text[at:]])


def washed(wikitext: str | None) -> str:
    """Wiki text as plain text; headings become lines that begin with '## ', list marks '- '."""
    text = without_spans(wikitext or "", re.compile("<!--"), "-->")
    text = re.sub(r"<ref\b[^<>]*/>", "", text)
    for name in ("ref", *DROPPED_ELEMENTS):
        text = without_spans(text, re.compile(rf"<{name}\b[^<>]*>", re.I), f"</{name}>")
    text = re.sub(r"<[^<>]+>", "", text)
    text = without_depth(rewritten_templates(text), "{|", "|}")
    text = re.sub("'{2,}", "", linked_text(text))
    lines = []
    for line in text.split("\n"):
        line = line.strip()
        bare = line.strip("=")
        if line and line[0] in "*;:":
            lines.append("- " + line.lstrip("*;:").lstrip())
        elif bare.strip() and line.startswith("==") and line.endswith("=="):
            lines += ["", "## " + bare.strip(), ""]
        else:
            lines.append(line)
    flat = re.sub(r"[ \t]+", " ", "\n".join(lines))
    return re.sub(r"\n{3,}", "\n\n", flat).strip()


def sections(text: str | None, least: int = 200, most: int = 900) -> list[dict]:
    """(section, content) of a washed text: the paragraphs of a section are packed up to ``most`` characters, packs shorter
    than ``least`` join the pack before them (of whichever section) where both stay below ``most``, and packs of a
    titled section begin with its title. A paragraph longer than ``most`` is a pack of its own, uncut."""
    packs: list[tuple[str, list[str], int]] = []
    for part in ("\n" + (text or "")).split("\n## "):
        title, newline, body = part.partition("\n")
        if part.startswith("\n") or not newline:
            title, body = "", part
        fresh = True
        for paragraph in filter(None, map(str.strip, body.split("\n\n"))):
            if fresh or packs[-1][2] + len(paragraph) + 2 > most:
                packs.append((title.strip(), [paragraph], len(paragraph)))
            else:
                packs[-1] = (packs[-1][0], packs[-1][1], packs[-1][2] + len(paragraph) + 2)
                packs[-1][1].append(paragraph)
            fresh = False
    merged: list[tuple[str, list[str], int]] = []
    for title, held, size in packs:
        if merged and size < least and merged[-1][2] + size < most:
            merged[-1][1].extend(held)
            merged[-1] = (merged[-1][0], merged[-1][1], merged[-1][2] + size + 2)
        else:
            merged.append((title, held, size))
    return [{"section": title, "content": (title + "\n" if title else "") + "\n\n".join(held)} for title, held, _ in merged]


def arrow(function: Callable, returns: str):
    """function of one text as an Arrow function of a column, whose batches are bounded as a worker holds the trees' records."""
    if (spark := SparkSession.getActiveSession()) is not None:
        bounded_batches(spark)

    @F.pandas_udf(returns)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.DataFrame(list(s.map(function)), columns=[f.name for f in kind.fields]) if struct else s.map(function)

    kind = T.DataType.fromDDL(returns)
    struct = isinstance(kind, T.StructType)
    return run


INFOBOX = "name string, fields map<string,string>, forms array<struct<label:string,values:map<string,string>>>"
RENDERED = "name string, overview array<string>, sections array<struct<heading:string,paras:array<string>,lists:array<array<string>>>>"
SECTIONS = "array<struct<section:string,content:string>>"
