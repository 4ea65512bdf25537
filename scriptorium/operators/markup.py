"""HTML of single values: visible text, blocks, table grids and layout-only edits.

A value is parsed where it lies, in Arrow batches and without a shuffle, into flat columns of nodes
(tag, parent, text, place in the source); everything else is read off those columns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Tags that start a line of their own, tags without content, layout-only tags, inline marks.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LAYOUT = frozenset("b center div em font i p section small span strong sub sup u".split())
MARKS = {"b": "strong", "strong": "strong", "i": "emphasis", "em": "emphasis", "u": "underline", "s": "strikethrough", "del": "strikethrough", "sub": "subscript", "sup": "superscript", "code": "code"}
_HIDDEN = frozenset(("script", "style"))
ROOT = -1
#: Columns that one cell reaches over at most, as in browsers.
MOST_COLUMNS = 1000


class Nodes(HTMLParser):
    """The nodes of a markup text, in order of appearance: tag (None for text), parent, text, attributes, start, end of the start tag."""

    def __init__(self, markup: str):
        super().__init__(convert_charrefs=False)
        self.tags: list[str | None] = []
        self.parents: list[int] = []
        self.texts: list[str] = []
        self.attrs: list[dict] = []
        self.spans: list[tuple[int, int]] = []
        self.closings: list[tuple[str, int, int, bool]] = []
        self._open: list[int] = []
        self._lines = [0, *(i + 1 for i, c in enumerate(markup) if c == "\n")]
        self.feed(markup)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def _add(self, tag: str | None, text: str = "", attrs: dict | None = None, size: int = 0) -> int:
        self.tags.append(tag)
        self.parents.append(self._open[-1] if self._open else ROOT)
        self.texts.append(text)
        self.attrs.append(attrs or {})
        self.spans.append((self._at(), self._at() + size))
        return len(self.tags) - 1

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, attrs=dict(attrs), size=len(self.get_starttag_text() or ""))
        if tag not in VOID:
            self._open.append(at)

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs=dict(attrs), size=len(self.get_starttag_text() or ""))

    def handle_endtag(self, tag):
        known = [i for i, at in enumerate(self._open) if self.tags[at] == tag]
        start = self._at()
        end = self.rawdata.find(">", start) + 1  # the markup is fed at once and stays whole while it is read
        self.closings.append((tag, start, max(end, start), bool(known) and known[-1] == len(self._open) - 1))
        if known:
            del self._open[known[-1] :]

    def handle_data(self, data):
        self._add(None, data, size=len(data))

    def handle_entityref(self, name):
        self._add(None, unescape(f"&{name};"), size=len(name) + 2)

    def handle_charref(self, name):
        self._add(None, unescape(f"&#{name};"), size=len(name) + 3)

    @property
    def left_open(self) -> bool:
        return bool(self._open)

    def children(self) -> dict[int, list[int]]:
        out: dict[int, list[int]] = {ROOT: []}
        for i, p in enumerate(self.parents):
            out.setdefault(p, []).append(i)
        return out


def _tidy(text: str) -> str:
    """Blanks of a line as one, empty lines dropped."""
    return "\n".join(x for x in (" ".join(line.split()) for line in text.splitlines()) if x)


def _walk(nodes: Nodes, roots: list[int]) -> Iterator[tuple[int, bool]]:
    """Nodes under ``roots`` in order, each with whether it is entered (else left); no recursion."""
    kids = nodes.children()
    stack = [(i, True) for i in reversed(roots)]
    while stack:
        i, entering = stack.pop()
        yield i, entering
        if entering:
            stack.append((i, False))
            if nodes.tags[i] not in _HIDDEN:
                stack.extend((k, True) for k in reversed(kids.get(i, [])))


def visible_text(nodes: Nodes, roots: list[int] | None = None) -> str:
    """Text as it shows: block tags and breaks end lines, blanks are one, empty lines and scripts are left out."""
    out: list[str] = []
    for i, entering in _walk(nodes, nodes.children()[ROOT] if roots is None else roots):
        tag = nodes.tags[i]
        if tag in _HIDDEN:
            continue
        if tag is None:
            if entering:
                out.append(nodes.texts[i])
        elif tag in ("br", "hr"):
            if entering:
                out.append("\n")
        elif tag in BLOCKS:
            out.append("\n")
    return _tidy("".join(out))


def rich_text(markup: str) -> dict:
    """The visible text of a markup, its link and media addresses and the entries it refers to."""
    nodes = Nodes(markup)
    links = [a.get("href") or "" for t, a in zip(nodes.tags, nodes.attrs) if t == "a" and a.get("href") is not None]
    media = [u for t, a in zip(nodes.tags, nodes.attrs) if t == "img" and (u := a.get("src") or a.get("data-image-url"))]
    entries = [a["data-entry-id"] for a in nodes.attrs if a.get("data-entry-id")]
    return {"text": visible_text(nodes), "links": links, "media": media, "entries": entries}


def blocks(markup: str) -> list[dict]:
    """Blocks (block_no, parent_no, kind, level, text, marks) of a markup in order; loose inline text is a paragraph.

    Kinds: paragraph, heading (with its level), list, item, quote, group, table, row, cell, separator. A
    block that holds blocks has no text of its own. Marks are "kind start end" in the block's text.
    """
    nodes = Nodes(markup)
    kids = nodes.children()
    holds = [False] * len(nodes.tags)
    for i in range(len(nodes.tags) - 1, -1, -1):
        if (nodes.tags[i] in BLOCKS or holds[i]) and nodes.parents[i] != ROOT:
            holds[nodes.parents[i]] = True
    out: list[dict] = []

    def emit(kind: str, parent: int | None, level: int | None = None, roots: list[int] | None = None) -> int:
        text, marks = _inline(nodes, roots) if roots is not None else ("", [])
        out.append({"block_no": len(out), "parent_no": parent, "kind": kind, "level": level, "text": text, "marks": marks})
        return len(out) - 1

    stack: list[tuple[list[int], int, int | None]] = [(kids[ROOT], 0, None)]
    while stack:
        siblings, at, parent = stack.pop()
        loose: list[int] = []
        while at < len(siblings) and nodes.tags[siblings[at]] not in BLOCKS and not holds[siblings[at]]:
            loose.append(siblings[at])
            at += 1
        if any(nodes.texts[i].strip() or nodes.tags[i] for i in loose) and (loose := [i for i in loose if nodes.tags[i] not in _HIDDEN]):
            emit("paragraph", parent, roots=loose)
        if at == len(siblings):
            continue
        i = siblings[at]
        stack.append((siblings, at + 1, parent))
        tag = nodes.tags[i] or ""
        if tag == "hr":
            emit("separator", parent)
        elif re.fullmatch("h[1-6]", tag) and not holds[i]:
            emit("heading", parent, int(tag[1]), [i])
        elif tag in ("p", "pre", "figcaption", "summary") and not holds[i]:
            emit("paragraph", parent, roots=[i])
        else:
            kind = {"ul": "list", "ol": "list", "li": "item", "blockquote": "quote", "table": "table", "tr": "row", "td": "cell", "th": "cell"}.get(tag, "group")
            stack.append((kids.get(i, []), 0, emit(kind, parent)))
    return out


def _inline(nodes: Nodes, roots: list[int]) -> tuple[str, list[str]]:
    """Text of inline nodes with their marks as "kind start end"."""
    parts: list[str] = []
    size = 0
    begun: dict[int, int] = {}
    marks: list[str] = []
    for i, entering in _walk(nodes, roots):
        tag = nodes.tags[i]
        if tag in _HIDDEN:
            continue
        if entering and (tag is None or tag == "br"):
            part = "\n" if tag == "br" else nodes.texts[i]
            parts.append(part)
            size += len(part)
        kind = MARKS.get(tag or "") or ("link" if tag == "a" and nodes.attrs[i].get("href") is not None else None)
        if kind and entering:
            begun[i] = size
        elif kind:
            marks.append(f"{kind} {begun[i]} {size}")
    return "".join(parts), marks


def table_cells(markup: str) -> list[dict]:
    """Cells (table_no, row, column, header, rowspan, colspan, text, problem) of all tables with the columns they really stand in.

    A cell takes the next column that no earlier cell reaches into; rowspan 0 reaches to the end of the
    table; a span that is no whole number counts as 1 and is named as the problem.
    """
    nodes = Nodes(markup)
    kids = nodes.children()
    out = []
    for number, t in enumerate(i for i, tag in enumerate(nodes.tags) if tag == "table"):
        rows: list[int] = []
        stack = list(reversed(kids.get(t, [])))
        while stack:
            i = stack.pop()
            if nodes.tags[i] == "tr":
                rows.append(i)
            elif nodes.tags[i] in ("thead", "tbody", "tfoot"):
                stack.extend(reversed(kids.get(i, [])))
        free_from: list[int] = []  # for each column the first row in which no earlier cell reaches into it
        for r, tr in enumerate(rows):
            column = 0
            for cell in (i for i in kids.get(tr, []) if nodes.tags[i] in ("td", "th")):
                while column < len(free_from) and free_from[column] > r:
                    column += 1
                raw = {k: nodes.attrs[cell].get(k, "1") or "" for k in ("rowspan", "colspan")}
                problem = next((k for k, v in raw.items() if not v.isdigit()), None)
                height, width = (int(v) if v.isdigit() else 1 for v in raw.values())
                width = min(max(1, width), MOST_COLUMNS)
                out.append({"table_no": number, "row": r, "column": column, "header": nodes.tags[cell] == "th", "rowspan": height, "colspan": width, "text": visible_text(nodes, kids.get(cell, [])), "problem": problem})
                free_from += [0] * (column + width - len(free_from))
                reach = len(rows) if height == 0 else r + height
                free_from[column : column + width] = [max(x, reach) for x in free_from[column : column + width]]
                column += width
    return out


def layout_edits(text: str) -> tuple[str, list[tuple[int, int, str]]]:
    """What replaces layout-only tags of a text: (status, edits (start, end, replacement)).

    Balanced layout tags vanish, paragraphs and breaks become line feeds. Any other tag, or one that
    is not balanced, leaves the whole text as it is ("preserved"); no tag at all is "identity".
    """
    nodes = Nodes(text)
    edits = []
    for tag, (start, end) in zip(nodes.tags, nodes.spans):
        if tag is not None:
            if tag not in LAYOUT and tag != "br":
                return "preserved", []
            edits.append((start, end, "\n" if tag == "br" else ""))
    if nodes.left_open or any(not inner for *_, inner in nodes.closings):
        return "preserved", []
    edits += [(start, end, "\n" if tag == "p" else "") for tag, start, end, _ in nodes.closings]
    edits.sort()
    if edits and not apply_edits(text, edits).strip():
        return "preserved", []
    return ("projected" if edits else "identity"), edits


def apply_edits(text: str, edits: list[tuple[int, int, str]]) -> str:
    """``text`` with the edits replayed; edits that overlap or lie outside raise ValueError."""
    out, at = [], 0
    for start, end, new in edits:
        if not at <= start < end <= len(text):
            raise ValueError(f"edit {start}:{end} is out of order or range")
        out += [text[at:start], new]
        at = end
    return "".join([*out, text[at:]])


def per_value(rows: DataFrame, key: str, markup: str, what: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """(key, *columns) rows that ``what`` gives for each markup value; null values give none."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    schema = StructType([rows.schema[key], *_parse_datatype_string(columns)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, found = [], []
            for i, value in enumerate(b.column(1).to_pylist()):
                got = what(value) if value is not None else []
                at += [i] * len(got)
                found += got
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array([x[j] for x in found], f.type) for j, f in enumerate(list(arrow)[1:]))], schema=arrow)

    return rows.select(key, F.col(markup)).mapInArrow(run, schema)
