"""HTML to text: a tree with implied tags, rendered with the spacing of its layout."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docgate.llm.common import slices

# Element names by how HTML parses and lays them out.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes noscript textarea title template".split())
UNSEEN = set("head script style template noscript iframe noembed noframes title datalist object audio video canvas".split())
#: Not drawn inside of svg and math.
UNDRAWN = set("desc metadata defs symbol annotation annotation-xml".split())
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr form menu dir listing xmp".split())
BLOCK = SPACED | set(
    "address article aside body center dd details dialog div dt figcaption footer header hgroup html legend li main nav optgroup option search section summary tr caption".split()
)
ENDS_P = (BLOCK - set("body html option optgroup tr caption".split())) | {"table"}
#: An open element that a start tag ends, and what it doesn't look past for one.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption"}, {"table", "tr"}),
    "th": ({"td", "th", "caption"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
ROOMS = {"html", "table", "td", "th", "caption", "template", "object"}  # an end tag isn't matched beyond these
FORMATTED = {"pre", "textarea", "listing", "xmp"}

_START = re.compile(
    r"""<([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+)*+)>"""
)
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_ATTRIBUTE = re.compile(r"""([^\s/>=]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_HIDDEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Table columns are aligned up to so many characters; longer cells stand whole and shift what follows.
ALIGN = 40
#: Fixed value: the most columns that HTML lets a cell span.
SPAN = 1000


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []

    def visible(self) -> bool:
        a = self.attributes
        if self.tag in UNSEEN or "hidden" in a or self.tag == "dialog" and "open" not in a:
            return False
        return not ("style" in a and _HIDDEN.search(a["style"].lower()))


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), unescape(value) if "&" in value else value)
    return found


def parse(html: str) -> Node:
    """The tree of a page, however deep. Tags that may be left out are implied, end tags without a start tag are ignored, and
    what stands in a tag that never ends is dropped. Any text parses."""
    root = Node("html", {})
    stack = [root]
    places: dict[str, list[int]] = {}  # where in the stack the open elements of each name are

    def open_(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def last(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close(names: set[str], stop: set[str]) -> None:
        at = last(names)
        if at and at >= last(stop):
            for node in stack[at:]:
                places[node.tag].pop()
            del stack[at:]

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    at, end = 0, len(html)
    while at < end:
        cut = html.find("<", at)
        if cut < 0:
            text(html[at:])
            break
        text(html[at:cut])
        after = html[cut + 1 : cut + 2]
        if after.isascii() and after.isalpha():
            m = _START.match(html, cut)
            if not m:
                break
            at = m.end()
            tag = m[1].lower()
            if tag in ("html", "body"):
                continue
            node = Node(tag, _attributes(m[2]) if m[2] else {})
            if tag in ENDED_BY:
                close(*ENDED_BY[tag])
                if tag in ("tr", "tbody", "thead", "tfoot"):  # ends rows and sections with cells left open
                    close({"tr"} if tag == "tr" else {"tr", *ENDED_BY[tag][0]}, {"table"})
            if tag in ENDS_P:
                close({"p"}, ROOMS | {"button"})
            if tag in ("td", "th") and stack[-1].tag not in ("tr", "template"):
                row = Node("tr", {})
                stack[-1].children.append(row)
                open_(row)
            stack[-1].children.append(node)
            if tag in VOID or m[2].endswith("/") and last({"svg", "math"}):
                continue
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                inner = html[at : stop.start()] if stop else html[at:]
                node.children.append(unescape(inner) if tag == "textarea" else inner)
                at = html.find(">", stop.end()) + 1 if stop else end
                if not at:
                    break
                continue
            open_(node)
        elif after == "/" and (m := _END.match(html, cut)):
            at = m.end()
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("html", "body"):
                close({tag}, set() if tag == "table" else ROOMS - {tag})
        elif html.startswith("<!--", cut):
            at = html.find("-->", cut + 2) + 3
            if at == 2:
                break
        elif after in ("!", "?", "/"):
            at = html.find(">", cut) + 1
            if not at:
                break
        else:
            text("<")
            at = cut + 1
    return root


class _Page:
    """Lines of text under construction."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.blank = False  # whether white space came since the last text of the line
        self.gap = 0  # blank lines due before the next text
        self.indent, self.mark = 0, ""

    def end_line(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.blank = False

    def space(self, lines: int) -> None:
        self.end_line()
        self.gap = max(self.gap, lines)

    def begin_line(self) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        lead = " " * max(0, self.indent - len(self.mark)) + self.mark
        if lead:
            self.now.append(lead)
        self.mark = ""

    def say(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        body = text.strip(" ")
        if not body:
            self.blank = self.blank or bool(text)
            return
        if not self.now:
            self.begin_line()
        elif self.blank or text[0] == " ":
            self.now.append(" ")
        self.now.append(body)
        self.blank = text[-1] == " "

    def say_as_is(self, text: str) -> None:
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.now:
                    self.begin_line()
                    self.now.append("")
                self.end_line()
            if line:
                if not self.now:
                    self.begin_line()
                self.now.append(line)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _rows(table: Node) -> tuple[list[Node], list[Node], list]:
    """The captions and visible rows of a table, not those of tables in it, and what stands in it, its sections and rows
    without being part of the grid."""
    captions, rows, loose, todo = [], [], [], [table]
    while todo:
        node = todo.pop()
        loose.append(" ")
        if node.tag == "caption":
            captions.append(node)
        elif node.tag == "tr":
            rows.append(node)
            loose.extend(c for c in node.children if isinstance(c, Node) and c.tag not in ("td", "th"))
        else:
            grid = [isinstance(c, Node) and c.tag in ("tr", "thead", "tbody", "tfoot", "caption") for c in node.children]
            loose.extend(c for c, part in zip(node.children, grid, strict=True) if not part)
            todo.extend(c for c, part in reversed(list(zip(node.children, grid, strict=True))) if part and c.visible())
    return captions, rows, loose


def _span(cell: Node) -> int:
    said = cell.attributes.get("colspan", "").strip()
    if not (said.isascii() and said.isdigit()):
        return 1
    return min(int(said), SPAN) if len(said) < 9 else SPAN


def _table(table: Node, page: _Page) -> Iterator:
    captions, rows, loose = _rows(table)
    page.space(1)
    for nodes in (loose, *(c.children for c in captions)):
        yield _nodes(nodes, page)
        page.end_line()
    grid = []
    for row in rows:
        cells = []
        for cell in row.children:
            if isinstance(cell, Node) and cell.tag in ("td", "th") and cell.visible():
                inner = _Page()
                yield _nodes(cell.children, inner)
                cells.append((_SPACE.sub(" ", inner.text()).strip(), _span(cell)))
            elif not isinstance(cell, Node) and cell.strip():
                cells.append((_SPACE.sub(" ", cell).strip(), 1))
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        column = 0
        for text, span in cells:
            if span <= 1:
                widths[column] = max(widths.get(column, 0), min(len(text), ALIGN))
            column += max(span, 1)
    for cells in grid:  # a cell over several columns widens the last of them
        column = 0
        for text, span in cells:
            if span > 1:
                inner = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
                last = column + span - 1
                widths[last] = widths.get(last, 0) + max(0, min(len(text), ALIGN) - inner)
            column += max(span, 1)
    for cells in grid:
        column, line = 0, []
        for i, (text, span) in enumerate(cells):
            span = max(span, 1)
            width = sum(widths.get(c, 0) for c in range(column, column + span)) + 2 * (span - 1)
            line.append(text if i == len(cells) - 1 else text.ljust(min(width, ALIGN * 4)))
            column += span
        said = "  ".join(line).rstrip()
        if said.strip():
            page.end_line()
            page.begin_line()
            page.now.append(said)
            page.end_line()
    page.space(1)


def _nodes(nodes: list, page: _Page) -> Iterator:
    """Write nodes in order. Yields the writing of tables, to be done before it goes on."""
    todo: list = [(n, False) for n in reversed(nodes)]
    lists: list[list] = []
    formatted = drawn = 0
    while todo:
        node, leaving = todo.pop()
        if not isinstance(node, Node):
            (page.say_as_is if formatted else page.say)(node)
            continue
        tag = node.tag
        if leaving:
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
                page.space(0 if lists else 1)
                page.indent -= 2 if len(lists) else 0
            elif tag in BLOCK:
                page.space(1 if tag in SPACED else 0)
            if tag in FORMATTED:
                formatted -= 1
            drawn -= tag in ("svg", "math")
            if tag == "li":
                page.mark = ""
            if tag in ("dd", "blockquote"):
                page.indent -= 2
            continue
        if not node.visible() or drawn and tag in UNDRAWN:
            continue
        if tag == "br":
            if page.now:
                page.end_line()
            elif page.lines:
                page.gap = max(page.gap, 1)
            continue
        if tag == "table":
            yield _table(node, page)
            continue
        children = node.children
        if tag in ("td", "th") or drawn and tag == "text":
            page.say(" ")
        if tag in ("ul", "ol", "menu", "dir"):
            page.space(0 if lists else 1)
            page.indent += 2 if lists else 0
            start = node.attributes.get("start", "1").strip()
            lists.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
        elif tag in BLOCK:
            page.space(1 if tag in SPACED else 0)
        if tag in FORMATTED:
            formatted += 1
        if tag == "li":
            page.mark = "- "
            if lists and lists[-1][0]:
                value = node.attributes.get("value", "").strip()
                if re.fullmatch(r"-?[0-9]{1,9}", value):
                    lists[-1][1] = int(value)
                page.mark = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            page.mark = " " * page.indent + page.mark
        if tag in ("dd", "blockquote"):
            page.indent += 2
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        if tag in VOID:
            continue
        drawn += tag in ("svg", "math")
        todo.append((node, True))
        todo.extend((c, False) for c in reversed(children))


def render(html: str) -> str:
    """The visible text of a page: blocks on lines of their own, blank lines around those with margins, list marks and
    indents, table cells in aligned columns, preformatted text as it is. Depth has no limit."""
    page = _Page()
    going = [_nodes(parse(html).children, page)]
    while going:  # tables in tables wait on this stack, not on Python's
        inner = next(going[-1], None)
        if inner is None:
            going.pop()
        else:
            going.append(inner)
    return page.text()


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """The columns of pages but `html`, and `text`, what a reader of the page would see.

    A null or empty page has an empty text; one without tags is its text. Other columns and repeated rows pass through, but for a
    column named text, which is replaced; no rows give no rows. No shuffle; each page is parsed whole."""
    names = [c for c in pages.columns if c not in (html, "text")]

    def run(batches):
        for batch in batches:
            for part in slices(batch, html):
                texts = [render(x) if x else "" for x in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string())], [*names, "text"])

    fields = [pages.schema[c] for c in names]
    return pages.mapInArrow(run, T.StructType([*fields, T.StructField("text", T.StringType())]))
