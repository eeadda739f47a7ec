"""Layout-aware HTML rendering to plain text.

A tokenizer finds tags, comments and text; a tree builder applies implied end
tags (paragraphs, list items, table parts, options, definition terms) and implied
rows; visibility rules drop what a browser doesn't show (head, scripts, styles,
templates, elements hidden by attribute, style or a simple rule of a style sheet);
a layout pass emits all visible text with block spacing, list marks and indents,
kept line breaks of pre, and table cells padded to their columns, which cells of
several rows or columns take up.

`display: none` hides all that an element holds; `visibility: hidden` hides its
text, but not that of elements inside that are visible again. Style rules count
for selectors of one tag, class or id, or a tag with classes, later ones over
earlier ones of the same weight; rules inside @media and the like are ignored. Of
svg the texts are shown, of object its fallback, of dialog and details what is
open.

Null and empty html give an empty text; text without tags is kept; an unclosed
comment, script or tag hides the rest or is text as in browsers. As in browsers,
elements nested deeper than MAX_DEPTH become neighbours of the deepest one; those
inside hidden ones stay hidden. Repeated rows and null ids give a row each, an
empty table an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_DEPTH = 256
#: Cells that a cell may cover across and down.
MOST_SPAN = 1000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe audio video canvas datalist noembed noframes area base link meta param source track rp desc defs symbol metadata annotation annotation-xml".split())
#: Blocks with an empty line around them, and blocks that only start a line.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure menu fieldset hr".split())
BLOCKS = SPACED | frozenset("html body address article aside center dd details dialog div dt fieldset figcaption footer form header hgroup legend li main nav optgroup option section summary tbody td tfoot th thead tr caption".split())
#: Opening a tag ends these open tags, searched up to the tags that hold them.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "tr": (("tr", "td", "th", "caption"), ("table",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
ENDS_P = BLOCKS - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "caption"}
#: An end tag reaches no further than these, unless it names one of them.
WALLS = frozenset("table td th caption html template".split())

NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
STOP = re.compile(r"[>\"']")
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z-]+)", re.I)
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?((?:[.#][\w-]+)*)", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SPACE = re.compile(r"[ \t\n\r\f]+")


def shows(declarations: str, at: tuple[bool | None, bool | None]) -> tuple[bool | None, bool | None]:
    """(displayed, visible) as declarations say over what was said before; None where nothing is said."""
    displayed, visible = at
    for m in NO_DISPLAY.finditer(declarations):
        displayed = m[1].lower() != "none"
    for m in VISIBILITY.finditer(declarations):
        visible = m[1].lower() not in ("hidden", "collapse")
    return displayed, visible


class Sheet:
    """The rules of style sheets that hide or show, by what their selectors end in."""

    def __init__(self):
        self.rules: dict[str, list] = {}
        self.count = 0

    def add(self, css: str) -> None:
        css, at = COMMENT.sub(" ", css), 0
        while (brace := css.find("{", at)) >= 0:
            selectors, depth, end = css[at:brace].rsplit(";", 1)[-1].strip(), 1, brace + 1
            if selectors.startswith("@"):  # a block of rules for other conditions
                while depth and end < len(css):
                    depth += {"{": 1, "}": -1}.get(css[end], 0)
                    end += 1
                at = end
                continue
            end = css.find("}", brace)
            end = len(css) if end < 0 else end
            body, at = css[brace + 1 : end], end + 1
            if shows(body, (None, None)) == (None, None):
                continue
            for selector in selectors.split(","):
                m = SELECTOR.fullmatch(selector.strip())
                if m and (m[1] or m[2]):
                    marks = re.findall(r"[.#][\w-]+", m[2])
                    self.count += 1
                    weight = sum(100 if x[0] == "#" else 10 for x in marks) + bool(m[1])
                    self.rules.setdefault(marks[-1] if marks else m[1].lower(), []).append((weight, self.count, m[1] and m[1].lower(), frozenset(marks), body))

    def said(self, tag: str, marks: set[str]) -> tuple[bool | None, bool | None]:
        """What the rules say of an element."""
        out: tuple[bool | None, bool | None] = (None, None)
        if self.rules:
            found = [r for key in (tag, *marks) for r in self.rules.get(key, ()) if (not r[2] or r[2] == tag) and r[3] <= marks]
            for *_, body in sorted(found, key=lambda r: r[:2]):
                out = shows(body, out)
        return out


class Node:
    __slots__ = ("tag", "attrs", "children", "shown", "visible")

    def __init__(self, tag: str, attrs: str = "", sheet: Sheet | None = None):
        self.tag, self.children = tag, []
        self.attrs: dict[str, str] = {}
        for m in ATTR.finditer(attrs) if attrs.strip(" /\n\t") else ():
            value = m[2] or ""
            value = value[1:-1] if value[:1] in ("'", '"') else value
            self.attrs.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
        marks = {"." + c for c in self.attrs.get("class", "").split()} | ({"#" + self.attrs["id"]} if self.attrs.get("id") else set())
        displayed, visible = sheet.said(tag, marks) if sheet else (None, None)
        if displayed is None:
            displayed = "hidden" not in self.attrs or self.attrs["hidden"].lower() == "until-found"
            displayed &= tag != "dialog" or "open" in self.attrs
        if style := self.attrs.get("style"):
            displayed, visible = shows(style, (displayed, visible))
        #: Whether it is there at all, and whether its text is seen (None: as around it).
        self.shown, self.visible = displayed and tag not in HIDDEN, visible

    def number(self, name: str) -> int | None:
        m = re.match(r"\s*([+-]?\d{1,9})", self.attrs.get(name, ""))
        return int(m[1]) if m else None

    def span(self, name: str) -> int:
        n = self.number(name)
        return 1 if n is None or n < 1 else min(n, MOST_SPAN)


def parse(source: str) -> Node:
    """The tree of a document; text children are strings."""
    root, sheet = Node("html"), Sheet()
    stack = [root]
    hidden = 0  # how many of the stack are inside a hidden element, itself included
    unpaired: set[str] = set()
    paired = True

    def cut(i: int) -> None:
        nonlocal hidden
        hidden = max(0, hidden - (len(stack) - i))
        del stack[i:]

    def close(tags: tuple[str, ...], walls) -> None:
        i = len(stack) - 1
        while i > 0 and stack[i].tag not in walls:
            if stack[i].tag in tags:
                cut(i)
            i -= 1

    def tag_end(at: int) -> int:
        """Where the tag's '>' stands, outside of quotes; a quote that nothing closes is a letter."""
        while m := STOP.search(source, at):
            if m[0] == ">":
                return m.start()
            at = m.end()
            if m[0] not in unpaired:
                other = source.find(m[0], at)
                if other < 0:
                    unpaired.add(m[0])
                else:
                    at = other + 1
        return -1

    pos, n = 0, len(source)
    while pos < n:
        at = source.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            stack[-1].children.append(html.unescape(source[pos:at]) if "&" in source[pos:at] else source[pos:at])
            pos = at
            continue
        if source.startswith("<!--", pos):
            end = source.find("-->", pos + 4)
            pos = n if end < 0 else end + 3
            continue
        if source.startswith(("<!", "<?"), pos):
            end = source.find(">", pos)
            pos = n if end < 0 else end + 1
            continue
        m = NAME.match(source, pos)
        if not m:
            stack[-1].children.append("<")
            pos += 1
            continue
        gt = tag_end(m.end()) if paired else -1
        if gt < 0:  # a quote ran over the end of the page: from here on quotes are letters
            paired, gt = False, source.find(">", m.end())
        if gt < 0:
            stack[-1].children.append(source[pos:])
            break
        pos, tag, attrs = gt + 1, m[2].lower(), source[m.end() : gt]
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in WALLS:
                    break
            continue
        if tag in ENDS_P:
            close(("p",), WALLS | {"button"})
        if tag in ENDS:
            close(*ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag != "tr" and any(x.tag == "table" for x in stack):
            stack[-1].children.append(row := Node("tr"))
            stack.append(row)
            hidden += hidden > 0
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        node = Node(tag, attrs, sheet)
        if len(stack) >= MAX_DEPTH and not hidden and tag not in VOID and tag not in RAW:
            cut(len(stack) - 1)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, pos)
            body = source[pos : end.start() if end else n]
            node.children.append(html.unescape(body) if tag in ("textarea", "title") else body)
            if tag == "style":
                sheet.add(body)
            gt = source.find(">", end.end()) if end else -1
            pos = n if gt < 0 else gt + 1
        elif tag not in VOID and not (attrs.endswith("/") and any(x.tag in ("svg", "math") for x in stack[-8:])):
            stack.append(node)
            hidden += hidden > 0 or not node.shown
    return root


class Flow:
    """Lines of text under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0
        self.space = False
        self.mark, self.indent = "", ""

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s == " ":
            self.space = bool(self.line)
            return
        if (s[0] == " " or self.space) and self.line:
            self.line.append(" ")
        self.line.append(s.strip(" "))
        self.space = s[-1] == " "

    def put(self, line: str) -> None:
        if self.lines and self.gap:
            self.lines.append("")
        self.gap = 0
        self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark if self.mark else self.indent) + line)
        self.mark = ""

    def end_line(self, always: bool = False) -> None:
        if self.line or always:
            self.put("".join(self.line))
        self.line, self.space = [], False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap |= spaced

    def result(self) -> list[str]:
        self.end_line()
        return self.lines


def render(node: Node, flow: Flow, pre: bool = False, numbers: list | None = None, seen: bool = True) -> None:
    """Put a node's children in the flow; `seen` is whether text is visible here."""
    for child in node.children:
        if isinstance(child, str):
            if not seen:
                continue
            if not pre:
                if child:
                    flow.text(child)
                continue
            first, *rest = child.replace("\r\n", "\n").split("\n")
            flow.line += [first] * bool(first)
            for part in rest:
                flow.end_line(always=True)
                flow.line += [part] * bool(part)
            continue
        tag = child.tag
        if tag == "br":
            flow.end_line(always=seen)
            continue
        if not child.shown:
            continue
        now = seen if child.visible is None else child.visible
        if tag == "table":
            flow.block(True)
            for line in table_lines(child, now):
                flow.put(line)
            flow.block(True)
        elif tag == "svg":
            for text in _svg_texts(child):
                flow.space = bool(flow.line)
                render(text, flow, False, None, now if text.visible is None else text.visible)
                flow.space = bool(flow.line)
        elif tag == "details" and "open" not in child.attrs:
            flow.block(False)
            closed = Node("details")
            closed.children = [x for x in child.children if isinstance(x, Node) and x.tag == "summary"][:1]
            render(closed, flow, pre, numbers, now)
            flow.block(False)
        elif tag in ("ul", "ol", "menu"):
            nested = bool(numbers)
            flow.block(not nested)
            start = child.number("start")
            render(child, flow, pre, [(1 if start is None else start) if tag == "ol" else None], now)
            flow.block(not nested)
        elif tag == "li":
            flow.end_line()
            mark = "- "
            if numbers and numbers[0] is not None:
                at = child.number("value")
                at = numbers[0] if at is None else at
                mark, numbers[0] = f"{at}. ", at + 1
            mark = mark if now else ""
            flow.indent += " " * len(mark)
            flow.mark = mark
            render(child, flow, pre, [None], now)
            flow.end_line()
            flow.indent, flow.mark = flow.indent[: len(flow.indent) - len(mark)], ""
        elif tag in BLOCKS:
            flow.block(tag in SPACED)
            depth = 4 if tag == "dd" else 2 if tag == "blockquote" else 0
            flow.indent += " " * depth
            render(child, flow, pre or tag == "pre", None if tag in ("td", "th") else numbers, now)
            flow.block(tag in SPACED)
            flow.indent = flow.indent[: len(flow.indent) - depth]
        else:
            render(child, flow, pre, numbers, now)


def _svg_texts(node: Node) -> Iterator[Node]:
    """The text elements of a drawing, in order."""
    for child in node.children:
        if isinstance(child, Node) and child.shown:
            if child.tag in ("text", "foreignobject"):
                yield child
            else:
                yield from _svg_texts(child)


def _rows(table: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
    """Rows and whether their text is visible."""
    for child in table.children:
        if isinstance(child, Node) and child.shown:
            now = seen if child.visible is None else child.visible
            if child.tag == "tr":
                yield child, now
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child, now)


def _loose(table: Node) -> Iterator[Node | str]:
    """What a table holds besides rows: its caption and misplaced content, shown before it."""
    for child in table.children:
        if isinstance(child, str):
            if child.strip():
                yield child
        elif child.tag in ("thead", "tbody", "tfoot"):
            if child.shown:
                yield from _loose(child)
        elif child.tag not in ("tr", "col", "colgroup"):
            yield child


def grid(table: Node, seen: bool = True) -> list[list[list[str]]]:
    """Lines of text of each cell by row and column; places that a cell covers besides its first are empty."""
    out: list[list[list[str]]] = []
    taken: dict[int, int] = {}  # rows that cells from above still cover in a column
    for row, shown in _rows(table, seen):
        cells: dict[int, list[str]] = {}
        below: dict[int, int] = {}
        at = 0
        for cell in row.children:
            if isinstance(cell, str) and not cell.strip():
                continue
            if isinstance(cell, Node) and not cell.shown:
                continue
            holder = cell
            if isinstance(cell, str) or cell.tag not in ("td", "th"):
                holder = Node("td")
                holder.children = [cell]
            while taken.get(at, 0):
                at += 1
            inner = Flow()
            render(holder, inner, seen=shown if holder.visible is None else holder.visible)
            cells[at] = inner.result() or [""]
            wide, high = holder.span("colspan"), holder.span("rowspan")
            for k in range(at, at + wide):
                cells.setdefault(k, [""])
                if high > 1:
                    below[k] = high - 1
            at += wide
        width = max([-1, *cells, *(k for k, left in taken.items() if left)]) + 1
        out.append([cells.get(k, [""]) for k in range(width)])
        taken = {k: left - 1 for k, left in taken.items() if left > 1} | below
    return out


def table_lines(table: Node, seen: bool = True) -> list[str]:
    """A table's caption, then its rows with cells padded to their columns."""
    before = Node("div")
    before.children = list(_loose(table))
    flow = Flow()
    render(before, flow, seen=seen)
    out, rows, widths = flow.result(), grid(table, seen), []
    for cells in rows:
        widths += [0] * (len(cells) - len(widths))
        for i, lines in enumerate(cells):
            widths[i] = max(widths[i], max(map(len, lines)))
    for cells in rows:
        for k in range(max(map(len, cells), default=0)):
            out.append(" | ".join((lines[k] if k < len(lines) else "").ljust(widths[i]) for i, lines in enumerate(cells)).rstrip(" "))
    return out


def to_text(source: str | None) -> str:
    """All visible text of a document."""
    if not source:
        return ""
    flow = Flow()
    render(parse(source), flow)
    return "\n".join(line.rstrip(" ") for line in flow.result()).strip("\n")


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([to_text(x.as_py()) for x in batch.column(1)], pa.string())], names=[id_col, "text"])

    return df.select(id_col, html_col).mapInArrow(run, f"{id_col} {dict(df.dtypes)[id_col]}, text string")
