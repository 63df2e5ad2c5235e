"""Layout-aware HTML extraction: all visible text, laid out as a page would show it.

A tree builder adds what pages leave out (html, head and body; ends of p, li, table parts,
options and terms), then a renderer walks the tree with an explicit stack, so depth is no
limit. Hidden are elements without a display (script, style, template, head ...) and what the
cascade of ``hidden``, the page's style sheets and inline styles leaves with ``display: none`` (with
all inside) or ``visibility: hidden`` (until something inside is made visible again); see ``styles``
for what of CSS is read. Blocks stand on lines of their own, with an empty line around
paragraphs and headings; lists are marked and indented; table cells are padded to aligned
columns, of at most ``COLUMN`` characters, wider text being wrapped; ``pre`` keeps its white space; text
of svg and math is text.

Defined results: null or empty html gives an empty text; broken mark-up is read as far as it
goes; rows that repeat a page_id each give a row; extra columns are ignored; an empty table gives
no rows. Closed ``details`` are shown; fall-back content of iframe, object, canvas and noscript is not.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .styles import Sheet

COLUMN = 60

# fixed values: element names by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
NO_DISPLAY = frozenset(
    "head script style template noscript title meta link base iframe object canvas audio video datalist".split()
    + "defs symbol clippath mask metadata desc annotation annotation-xml".split()  # of svg and math
)
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
BLOCKS = PARAGRAPHS | frozenset("html body address article aside dd details dialog div dt fieldset figcaption footer form header hgroup hr li main menu nav section summary tr caption legend optgroup option thead tbody tfoot".split())
CLOSES_P = BLOCKS - frozenset("html body li dd dt tr caption legend optgroup option thead tbody tfoot summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TABLE_PARTS = frozenset("td th tr thead tbody tfoot caption colgroup".split())
#: start tag -> (open elements that it ends, elements beyond which it does not look)
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"tr", "table"}),
    "tr": ({"td", "th", "tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tbody": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"td", "th", "tr", "thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
}
FOREIGN = ("svg", "math")
SHOWN_INPUTS = frozenset("text search email url tel number date time submit reset button".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
_OPENING = re.compile("<[A-Za-z/!?]")


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], None

    def append(self, node: Node) -> None:
        node.parent = self
        self.children.append(node)


class Fixed(str):
    """A line that keeps its layout."""


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.body = Node("body")
        self.head = Node("head")
        self.root.append(self.head), self.root.append(self.body)
        self.open = [self.root, self.body]
        self.count: Counter[str] = Counter()  # of open elements, so that most searches end at once
        self.in_head = True
        self.sheets: list[str] = []

    def _push(self, node: Node) -> None:
        self.open.append(node)
        self.count[node.tag] += 1

    def _cut(self, k: int) -> None:
        self.count.subtract(node.tag for node in self.open[k:])
        del self.open[k:]

    def _close_to(self, names: set[str], stop: set[str]) -> None:
        """Close the outermost open element of ``names`` above the nearest one of ``stop``."""
        cut = None
        left = sum(self.count[name] for name in names)
        for k in range(len(self.open) - 1, 1, -1):
            if not left or self.open[k].tag in stop:
                break
            if self.open[k].tag in names:
                cut, left = k, left - 1
        if cut is not None:
            self._cut(cut)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        values = {k: v or "" for k, v in attrs}
        if tag in ("html", "body"):
            (self.root if tag == "html" else self.body).attrs |= values
            self.in_head = self.in_head and tag != "body"
            return
        if tag == "head":
            return
        node = Node(tag, values)
        if self.in_head and tag in HEAD_ONLY and len(self.open) == 2:
            self.head.append(node)
            if tag not in VOID:
                self._push(node)
            return
        self.in_head = False
        if tag in IMPLIED_ENDS:
            self._close_to(*IMPLIED_ENDS[tag])
        if tag in CLOSES_P:
            self._close_to({"p"}, {"table", "td", "th", "button", "caption"})
        if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self.handle_starttag("tr", [])
        self.open[-1].append(node)
        if tag not in VOID:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        """The slash ends an element of svg or math; in HTML it means nothing."""
        foreign = tag in FOREIGN or any(self.count[x] for x in FOREIGN)
        self.handle_starttag(tag, attrs)
        if foreign and len(self.open) > 2 and self.open[-1].tag == tag:
            self._cut(len(self.open) - 1)
            self.clear_cdata_mode()

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """CDATA apart, a marked section is a bogus comment: it ends at the next bracket."""
        if self.rawdata.startswith("<![CDATA[", i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, 0)

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.in_head = False
        if tag in ("html", "body", "head") or tag in VOID - {"br"}:
            return
        if tag == "br":
            self.handle_starttag("br", [])
            return
        alike = HEADINGS if tag in HEADINGS else {tag}
        for k in range(len(self.open) - 1, 1, -1) if any(self.count[x] for x in alike) else ():
            name = self.open[k].tag
            if name in alike:
                self._cut(k)
                return
            if name in ("td", "th", "table") and tag not in TABLE_PARTS | {"table"}:
                break
        if tag == "p":
            self.open[-1].append(Node("p"))

    def handle_data(self, data: str) -> None:
        node = self.open[-1]
        if node.tag == "style":
            self.sheets.append(data)
        if len(self.open) == 2 and data.strip():
            self.in_head = False
        node.children.append(data)


def style_of(node: Node, sheet: Sheet) -> tuple[bool, bool | None]:
    """(displayed, visible): the latter None where it is inherited."""
    if node.tag in NO_DISPLAY or node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False, None
    display, visibility = sheet.computed(node)
    shown = "hidden" not in node.attrs if display is None else display != "none"
    return shown, None if visibility in (None, "inherit", "unset") else visibility not in ("hidden", "collapse")


class _Flow:
    """Lines of one block context: the page, or a table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = 0  # empty lines wanted before the next text
        self.space = False
        self.indent: list[str] = []
        self.mark = ""
        self.fixed = False

    def text(self, data: str, keep: bool) -> None:
        if keep:
            first, *rest = data.split("\n")
            self._put(first)
            self.fixed |= bool(first)
            for line in rest:
                self.end_line(True)
                self._put(line)
                self.fixed = bool(line)
            return
        for k, word in enumerate(_SPACE.split(data)):
            if k:
                self.space = True
            if word:
                if self.space and self.now:
                    self.now.append(" ")
                self.space = False
                self._put(word)

    def _put(self, word: str) -> None:
        if word:
            if not self.now:
                if self.lines and self.gap:
                    self.lines += [""] * self.gap
                self.gap = 0
                self.now.append("".join(self.indent) + self.mark)
                self.indent = [" " * len(x) for x in self.indent] if self.indent else self.indent
                if self.mark:
                    self.mark = ""
            self.now.append(word)

    def end_line(self, force: bool = False) -> None:
        if self.now:
            line = "".join(self.now).rstrip()
            self.lines.append(Fixed(line) if self.fixed else line)
        elif force and self.lines:
            self.lines.append("")
        self.now, self.space, self.fixed = [], False, False

    def block(self, gap: int) -> None:
        self.end_line()
        self.gap = max(self.gap, gap)

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def wrapped(lines: list[str], most: int) -> list[str]:
    """Lines of at most ``most`` characters, cut between words; laid-out lines and long words stay whole."""
    out = []
    for line in lines:
        if len(line) <= most or isinstance(line, Fixed):
            out.append(line)
            continue
        indent = line[: len(line) - len(line.lstrip())]
        now, size = [], 0
        for word in line.split():
            if now and size + 1 + len(word) > most:
                out.append(indent + " ".join(now))
                now, size = [], 0
            size += len(word) + bool(now) if now else len(indent) + len(word)
            now.append(word)
        out.append(indent + " ".join(now))
    return out


def table_lines(rows: list[list[list[str]]], most: int = COLUMN) -> list[str]:
    """Rows of cells (lists of lines), each column padded to its widest line, or to ``most``."""
    width: dict[int, int] = {}
    for row in rows:
        row[:] = [cell if k == 0 and len(row) == 1 else wrapped(cell, most) for k, cell in enumerate(row)]
        for k, cell in enumerate(row):
            width[k] = max([width.get(k, 0), *(min(len(x), most) for x in cell)])
    out = []
    for row in rows:
        for line in range(max([0, *map(len, row)])):
            out.append("  ".join((cell[line] if line < len(cell) else "").ljust(width[k]) for k, cell in enumerate(row)).rstrip())
    return out


def render(root: Node, sheet: Sheet) -> str:
    flows, tables, lists = [_Flow()], [], []
    keep = 0
    stack: list[tuple[Node | str, bool, bool]] = [(root, True, True)]
    while stack:
        node, enter, seen = stack.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if seen:
                flow.text(node, keep > 0)
            continue
        tag = node.tag
        if enter:
            shown, own = style_of(node, sheet)
            if not shown:
                continue
            seen = seen if own is None else own
            stack.append((node, False, seen))
            stack.extend((child, True, seen) for child in reversed(node.children))
            if tag == "table":
                flow.block(1)
                tables.append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1]:
                    tables[-1].append([])
                flows.append(_Flow())
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in BLOCKS:
                flow.block(int(tag in PARAGRAPHS and not (tag in ("ul", "ol") and lists)))
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "")
                lists.append(int(start) if tag == "ol" and re.fullmatch(r"-?[0-9]{1,9}", start) else 1 if tag == "ol" else None)
            elif tag == "li" and seen:
                depth = max(len(lists) - 1, 0)
                number = lists[-1] if lists else None
                if number is not None and re.fullmatch(r"-?[0-9]{1,9}", node.attrs.get("value", "")):
                    lists[-1] = number = int(node.attrs["value"])
                flow.mark = "  " * depth + (f"{number}. " if number is not None else "- ")
                if number is not None:
                    lists[-1] += 1
            elif tag == "dd" or tag == "blockquote":
                flow.indent.append("    ")
            elif tag == "pre" or tag == "textarea":
                keep += 1
                if seen and tag == "textarea" and not node.children:
                    flow.text(node.attrs.get("placeholder", ""), False)
            elif tag == "br":
                flow.end_line(True)
            elif tag == "img" and seen and node.attrs.get("alt"):
                flow.text(node.attrs["alt"], False)
            elif tag == "input" and seen and (node.attrs.get("type") or "text").lower() in SHOWN_INPUTS:
                flow.text(node.attrs.get("value") or node.attrs.get("placeholder", ""), False)
        else:
            if tag in ("td", "th") and tables:
                cell = flows.pop().done()
                tables[-1][-1].append(cell)
                span = node.attrs.get("colspan", "")
                if re.fullmatch("[0-9]{1,3}", span):
                    tables[-1][-1].extend([] for _ in range(int(span) - 1))
                continue
            if tag == "table":
                rows = tables.pop()
                for line in table_lines([r for r in rows if r]):
                    flow.text(line or " ", True)
                    flow.end_line(True)
                flow.block(1)
            elif tag in BLOCKS and tag != "tr":
                flow.block(int(tag in PARAGRAPHS and not (tag in ("ul", "ol") and len(lists) > 1)))
            if tag in ("ul", "ol", "menu") and lists:
                lists.pop()
            elif tag in ("dd", "blockquote") and flow.indent:
                flow.indent.pop()
            elif tag in ("pre", "textarea"):
                keep -= 1
            elif tag == "li":
                flow.mark = ""
    return "\n".join(flows[0].done())


def closed(html: str) -> str:
    """Without a tag or comment that the end of the page cuts off, which no browser shows either. What
    opens after the last closing bracket never closes, so one search finds it."""
    cut = _OPENING.search(html, html.rfind(">") + 1)
    return html[: cut.start()] if cut else html


def extract(html: str | None) -> str:
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(closed(html))
    builder.close()
    return render(builder.root, Sheet(builder.sheets))


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per page: id, text."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return pages.select(id_col, html_col).mapInArrow(run, f"{id_col} {kind}, text string")
