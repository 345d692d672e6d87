"""HTML extraction by layout-aware rendering: all visible text, laid out as text.

A tree is built from the markup with implied tags (an open paragraph, item, row or cell ends where the next
one starts), invisible parts are left out, and the rest is rendered: inline text flows with its white space
collapsed, blocks start on lines of their own with blank lines where margins are, lists are marked and
indented, table cells are padded so that columns line up, and preformatted text stays as it is.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INVISIBLE = frozenset(
    "head title script style template noscript iframe object svg math audio video canvas datalist base link meta".split()
)
#: Blocks, and the blank lines that their margins make.
BLOCKS = {name: 0 for name in "html body div section article aside header footer main nav address form fieldset legend".split()}
BLOCKS |= {name: 0 for name in "details summary dialog figcaption hgroup li dt dd center table caption tr tbody thead tfoot option".split()}
BLOCKS |= {name: 1 for name in "p h1 h2 h3 h4 h5 h6 ul ol menu dl pre blockquote figure hr search".split()}
LISTS = frozenset(("ul", "ol", "menu", "dir"))
CELLS = frozenset(("td", "th"))
#: A start tag ends an open element of these names, unless one of the barriers stands between.
_ENDS = {
    "li": (("li",), LISTS),
    "dt": (("dt", "dd"), frozenset(("dl",))),
    "dd": (("dt", "dd"), frozenset(("dl",))),
    "option": (("option",), frozenset(("select", "datalist"))),
    "optgroup": (("option", "optgroup"), frozenset(("select",))),
    "tr": (("tr", "td", "th", "caption"), frozenset(("table",))),
    "td": (("td", "th"), frozenset(("table", "tr"))),
    "th": (("td", "th"), frozenset(("table", "tr"))),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), frozenset(("table",))),
    "body": (("head",), frozenset()),
}
_ENDS["thead"] = _ENDS["tfoot"] = _ENDS["tbody"]
_CLOSES_P = frozenset(name for name in BLOCKS if name not in ("html", "body", "option", "caption", "tr", "tbody", "thead", "tfoot"))
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Where an end tag may not look further up.
_SCOPE = frozenset(("table", "td", "th", "caption", "button", "html"))
#: End tags that reach through a scope.
_THROUGH = frozenset(("table", "tr", "tbody", "thead", "tfoot", "body"))
_HIDDEN_STYLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\s*(?:!important\s*)?(?:;|$)", re.I)
_OPEN_TAG = re.compile("</?[a-zA-Z]")
_SPACES = re.compile(r"[ \t\n\r\f]+")


@dataclass
class Element:
    name: str
    attributes: dict[str, str | None] = field(default_factory=dict)
    children: list = field(default_factory=list)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("html")
        self.open = [self.root]
        #: Where each name stands in the stack of open elements, so that no tag has to search a deep one.
        self.places: dict[str, list[int]] = {"html": [0]}

    def handle_starttag(self, name: str, attributes: list) -> None:
        if name == "html":
            return
        if self.open[-1].name == "head" and name not in INVISIBLE and name != "head":
            self._cut(len(self.open) - 1)  # content that cannot stand in a head ends it
        if name in _ENDS:
            self._end_open(*_ENDS[name])
        if name in _CLOSES_P:
            self._end_open(("p",), _SCOPE)
        if name in _HEADINGS and self.open[-1].name in _HEADINGS:
            self._cut(len(self.open) - 1)
        if name in CELLS and self._within("table") and not self._row_open():
            self._push(Element("tr"))
        self._push(Element(name, dict(attributes)), stays=name not in VOID)

    def handle_startendtag(self, name: str, attributes: list) -> None:
        self.handle_starttag(name, attributes)  # a slash means nothing in HTML but on void elements

    def handle_endtag(self, name: str) -> None:
        if name == "br":
            self._push(Element("br"), stays=False)
            return
        if name == "p" and not self._within("p"):
            self._push(Element("p"), stays=False)  # a lone end tag is an empty paragraph
            return
        found = self._last(_HEADINGS if name in _HEADINGS else (name,))
        if found > 0 and (name in _THROUGH or self._last(_SCOPE) <= found):
            self._cut(found)

    def handle_data(self, data: str) -> None:
        if self.open[-1].name == "head" and data.strip():
            self._cut(len(self.open) - 1)
        self.open[-1].children.append(data)

    def _push(self, element: Element, stays: bool = True) -> None:
        self.open[-1].children.append(element)
        if stays:
            self.places.setdefault(element.name, []).append(len(self.open))
            self.open.append(element)

    def _cut(self, at: int) -> None:
        """Ends the open elements from a place on."""
        for element in self.open[at:]:
            self.places[element.name].pop()
        del self.open[at:]

    def _last(self, names) -> int:
        """The innermost place of these names, -1 if none is open."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _within(self, name: str) -> bool:
        return bool(self.places.get(name))

    def _row_open(self) -> bool:
        return self._last(("tr",)) > self._last(("table",))

    def _end_open(self, names: tuple[str, ...], barriers: frozenset[str]) -> None:
        """Ends the outermost open element of these names that no barrier hides."""
        if self._last(names) < 0:
            return
        barrier = self._last(barriers)
        after = (bisect_right(self.places[n], barrier) for n in names if self.places.get(n))
        places = [p[k] for p, k in zip((self.places[n] for n in names if self.places.get(n)), after, strict=True) if k < len(p)]
        found = min(places, default=0)
        if found > 0:
            self._cut(found)


def parse(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    if _OPEN_TAG.match(builder.rawdata):  # a tag that the text ends in shows nothing
        builder.rawdata = ""
    builder.close()
    return builder.root


def visible(element: Element) -> bool:
    attributes = element.attributes
    if element.name in INVISIBLE or "hidden" in attributes:
        return False
    style = attributes.get("style")
    return not (style and _HIDDEN_STYLE.search(style))


class _Page:
    """Lines under way. Text is collapsed; margins are kept until the next text asks for them."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # collapsed white space waits for a word after it
        self.blank = 0
        self.mark = ""  # of a list item, before its first text
        self.indent = 0

    def text(self, data: str) -> None:
        words = _SPACES.split(data)
        if len(words) == 1 and not words[0]:
            return
        lead, trail = data[:1] in " \t\n\r\f", data[-1:] in " \t\n\r\f"
        flow = " ".join(w for w in words if w)
        if not flow:
            self.space = self.space or bool(self.line)
            return
        if (lead or self.space) and self.line:
            flow = " " + flow
        self.line.append(flow)
        self.space = trail

    def end_line(self) -> None:
        if self.line:
            self._put("".join(self.line))
        self.line, self.space = [], False

    def _put(self, text: str) -> None:
        if self.lines:
            self.lines += [""] * self.blank
        self.blank = 0
        pad = " " * self.indent
        if self.mark:
            pad = pad[: max(0, len(pad) - len(self.mark))] + self.mark
            self.mark = ""
        self.lines.append(pad + text)

    def margin(self, lines: int) -> None:
        self.end_line()
        self.blank = max(self.blank, lines)

    def raw(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            self._put(line)

    def result(self) -> str:
        self.end_line()
        return "\n".join(line.rstrip() for line in self.lines).strip("\n")


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def _table_rows(table: Element) -> tuple[list[Element], list[list[Element]]]:
    """Captions and the rows' cells of a table; nested tables belong to their cells."""
    captions, rows, todo = [], [], [c for c in reversed(table.children) if isinstance(c, Element)]
    while todo:
        element = todo.pop()
        if not visible(element):
            continue
        if element.name == "caption":
            captions.append(element)
        elif element.name == "tr":
            rows.append([c for c in element.children if isinstance(c, Element) and c.name in CELLS and visible(c)])
        else:
            todo += [c for c in reversed(element.children) if isinstance(c, Element)]
    return captions, rows


def _span(cell: Element, name: str) -> int:
    value = cell.attributes.get(name) or "1"
    return max(1, int(value)) if value.isdecimal() and len(value) < 5 else 1


def _stray(table: Element) -> list:
    """Text and elements of a table outside its rows and captions, which browsers show before it."""
    out, todo = [], list(reversed(table.children))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip():
                out.append(child)
        elif child.name in ("tbody", "thead", "tfoot", "tr"):
            todo += [c for c in reversed(child.children) if isinstance(c, str) or child.name != "tr" or c.name not in CELLS]
        elif child.name not in ("caption", "colgroup", "col", "tr"):
            out.append(child)
    return out


def _table_lines(rows: list[list[list[str]]], spans: list[list[tuple[int, int]]]) -> list[str]:
    """Cells (lists of lines) placed on a grid and padded to their columns; a spanning cell fills its first."""
    grid: dict[tuple[int, int], list[str]] = {}
    taken: set[tuple[int, int]] = set()
    columns = 0
    for r, (cells, sizes) in enumerate(zip(rows, spans, strict=True)):
        c = 0
        for cell, (across, down) in zip(cells, sizes, strict=True):
            while (r, c) in taken:
                c += 1
            grid[r, c] = cell
            across = min(across, 100)
            taken |= {(r + i, c + j) for i in range(min(down, len(rows) - r)) for j in range(across)}
            c += across
        columns = max(columns, c)
    widths = [0] * columns
    for (r, c), cell in grid.items():
        widths[c] = max([widths[c], *map(_width, cell)])
    used = [c for c in range(columns) if widths[c]]
    lines = []
    for r in range(len(rows)):
        height = max((len(grid.get((r, c), [])) for c in used), default=0)
        for n in range(height):
            parts = []
            for c in used:
                cell = grid.get((r, c), [])
                text = cell[n] if n < len(cell) else ""
                parts.append(text + " " * (widths[c] - _width(text)))
            lines.append("  ".join(parts).rstrip())
    return lines


def render(root: Element) -> str:
    """The visible text of a tree. Elements are walked with a stack of steps, so nesting has no limit."""
    finished: list[str] = []
    pages = [_Page()]
    todo: list = [("element", root, None)]
    while todo:
        step, item, extra = todo.pop()
        page = pages[-1]
        if step == "element":
            if isinstance(item, str):
                if extra == "pre":
                    lines = item.replace("\r\n", "\n").split("\n")
                    page.line.append(lines[0])
                    for line in lines[1:]:
                        page._put("".join(page.line))
                        page.line = [line]
                else:
                    page.text(item)
                continue
            if not visible(item):
                continue
            _enter(item, extra, page, todo)
        elif step == "close":
            page.margin(item)
        elif step == "indent":
            page.end_line()
            page.indent += item
        elif step == "mark":
            page.end_line()
            page.mark = item
        elif step == "inner":  # a cell or caption is rendered on a page of its own
            pages.append(_Page())
        elif step == "outer":
            finished.append(pages.pop().result())
        elif step == "lay":
            spans, after = item, extra
            total = sum(map(len, spans))
            texts = iter(finished[len(finished) - total :])
            del finished[len(finished) - total :]
            rows = [[next(texts).split("\n") for _ in row] for row in spans]
            page.raw(_table_lines(rows, spans))
            page.margin(after)
    return pages[0].result()


def _enter(element: Element, extra, page: _Page, todo: list) -> None:
    name = element.name
    if name == "br":
        if page.line:
            page.end_line()
        else:
            page._put("")
        return
    if name in VOID:
        if name == "hr":
            page.margin(1)
        elif name == "input" and (element.attributes.get("type") or "text").lower() in ("submit", "button", "reset"):
            page.text(element.attributes.get("value") or "")
        return
    if name == "table":
        _enter_table(element, page, todo)
        return
    children = element.children
    if name == "details" and "open" not in element.attributes:
        children = [c for c in children if isinstance(c, Element) and c.name == "summary"]
    mode = "pre" if name in ("pre", "listing", "textarea") or extra == "pre" else None
    after: list = []
    if name in BLOCKS:
        nested = name in LISTS and page.indent > 0
        margin = 0 if nested else BLOCKS[name]
        page.margin(margin)
        after.append(("close", margin, None))
    if name in LISTS:
        page.indent += 2
        after.append(("indent", -2, None))
        number = _start(element)
        steps: list = []
        for child in children:
            if name == "ol" and isinstance(child, Element) and child.name == "li" and visible(child):
                value = child.attributes.get("value") or ""
                number = int(value) if value.lstrip("-").isdecimal() and len(value) < 10 else number
                steps += [("mark", f"{number}. ", None), ("element", child, "numbered")]
                number += 1
            else:
                steps.append(("element", child, mode))
        todo += after[::1] + steps[::-1]
        return
    if name == "li" and extra != "numbered":
        page.mark = "- "
        page.indent = max(page.indent, 2)
    if name in ("blockquote", "dd"):
        page.indent += 4
        after.append(("indent", -4, None))
    if name == "pre" and children and isinstance(children[0], str) and children[0].startswith("\n"):
        children = [children[0][1:], *children[1:]]
    todo += after + [("element", c, mode) for c in reversed(children)]


def _start(element: Element) -> int:
    value = element.attributes.get("start") or "1"
    return int(value) if value.lstrip("-").isdecimal() and len(value) < 10 else 1


def _enter_table(table: Element, page: _Page, todo: list) -> None:
    page.margin(1)
    captions, rows = _table_rows(table)
    spans = [[(_span(c, "colspan"), _span(c, "rowspan")) for c in row] for row in rows]
    steps: list = []
    for child in _stray(table):
        steps.append(("element", child, None))
    for caption in captions:
        steps += [("close", 0, None), *[("element", c, None) for c in caption.children], ("close", 0, None)]
    for row in rows:
        for cell in row:
            steps += [("inner", None, None), *[("element", c, None) for c in cell.children], ("outer", None, None)]
    steps.append(("lay", spans, 1))
    todo += reversed(steps)


def html_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html.replace("\x00", "")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 200):
            batch = whole.slice(start, 200)
            texts = [html_text(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(texts, pa.string()),
                    pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                    pa.array([None if t is None else (t.count("\n") + 1 if t else 0) for t in texts], pa.int64()),
                ],
                names=["page_id", "text", "n_chars", "n_lines"],
            )


def extract_html(pages: DataFrame) -> DataFrame:
    """page_id, text, n_chars, n_lines per row of ``pages`` (page_id, html; others are ignored). No shuffle.

    A null html has a null text; an empty one, or one that shows nothing, has an empty text of 0 lines;
    repeated rows each get a row; null ids stay null; an empty table gives an empty result. Markup of any
    depth, length and brokenness is rendered whole.
    """
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html"))
    return narrow.mapInArrow(_extract, "page_id long, text string, n_chars long, n_lines long")
