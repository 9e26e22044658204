"""Layout-aware text of HTML pages.

A small tree builder supplies the end tags that HTML lets authors leave out;
the renderer drops what a browser doesn't show and writes the rest with block
spacing, list markers and indents, preformatted text, and tables whose cells line up in columns.
One page at a time, whole; a narrow stage over the input splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracemill.llm.common import batches

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is never shown.
UNSEEN = frozenset("head title script style template noscript iframe object svg canvas audio video datalist math".split())
#: Blocks with a blank line around them, and those with a line break only.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
PLAIN = frozenset(
    "address article aside body details dialog dd div dt figcaption footer form header html legend li main menu nav option section summary "
    "caption tbody thead tfoot tr td th center".split()
)
#: Start tags that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
#: For a start tag: the open elements that it ends, and those that such a search doesn't leave.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "table"}),
    "optgroup": ({"option", "optgroup"}, {"select", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: Lines of table cells are folded between words at this width, so that columns stay aligned; a longer word stays whole and moves the rest of its line.
WIDEST = 48
#: The HTML standard's bounds of colspan and rowspan.
MOST_COLUMNS, MOST_ROWS = 1000, 65534

_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Node:
    __slots__ = ("children", "hidden", "lines", "number", "shown", "span", "tag")

    def __init__(self, tag: str):
        self.tag, self.children, self.hidden = tag, [], False
        self.shown = True  # by visibility, which elements inside may take back, as they can't for hidden
        self.lines: list[str] = []  # of a table, once it is rendered
        self.span, self.number = (1, 1), None


def _whole(value: str | None, least: int, most: int, default: int) -> int:
    return min(max(int(value), least), most) if value and value.strip().lstrip("-").isdecimal() and len(value) < 9 else default


class TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.stack = [self.root]
        self.open: dict[str, int] = {}

    def _pop_to(self, depth: int) -> None:
        for node in self.stack[depth:]:
            self.open[node.tag] -= 1
        del self.stack[depth:]

    def _close(self, tags, bounds) -> None:
        """End the innermost open element of `tags`, unless one of `bounds` is met first."""
        if not any(self.open.get(t) for t in tags):
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in tags:
                self._pop_to(depth)
                return
            if tag in bounds:
                return

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if self.open.get("head") and tag not in IN_HEAD and tag != "head":
            self._close({"head"}, ())
        if tag in ENDS_P:
            self._close({"p"}, {"table", "td", "th", "caption", "button"})
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        node = Node(tag)
        node.shown = self.stack[-1].shown
        if attrs:
            held = dict(attrs)
            style = held.get("style")
            if style and (said := _VISIBILITY.findall(style)):
                node.shown = said[-1].lower() == "visible"
            if tag == "input":
                node.hidden = (held.get("type") or "").lower() not in ("submit", "button", "reset")
                node.children = [(held.get("value") or "") if node.shown else ""]
            node.hidden = node.hidden or "hidden" in held or bool(style and _HIDING.search(style))
            if tag in ("td", "th"):
                node.span = (_whole(held.get("colspan"), 1, MOST_COLUMNS, 1), _whole(held.get("rowspan"), 1, MOST_ROWS, 1))
            if tag in ("ol", "li"):
                name = "start" if tag == "ol" else "value"
                node.number = _whole(held.get(name), -(10**8), 10**8, 0) if name in held else None
            node.hidden = node.hidden or (tag == "dialog" and "open" not in held)
        elif tag in ("dialog", "input"):
            node.hidden = True
        self.stack[-1].children.append(node)
        if tag not in VOID:
            self.stack.append(node)
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # HTML has no self-closing elements but the void ones

    def handle_endtag(self, tag):
        if tag in ("html", "body"):
            return  # what follows still belongs to the body
        if tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and not self.open.get("p"):
            self.handle_starttag("p", [])
            self._close({"p"}, ())
        else:
            # a cell's content can't end what stands outside the cell, unless it is table structure
            bounds = () if tag in ("table", "tbody", "thead", "tfoot", "tr", "td", "th") else ("td", "th", "caption")
            self._close({tag}, bounds)

    def handle_data(self, data):
        if self.open.get("head") and self.stack[-1].tag == "head":
            if not data.strip():
                return
            self._close({"head"}, ())
        if self.stack[-1].shown:
            self.stack[-1].children.append(data)


class Lines:
    """Output lines; white space between words collapses, blank lines between blocks too."""

    def __init__(self):
        self.done: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.gap = False
        self.prefix = ""
        self.indent = ""

    def text(self, data: str) -> None:
        """Inline text in the normal flow."""
        flat = _SPACE.sub(" ", data)
        if flat.startswith(" "):
            self.space = True
            flat = flat[1:]
        if not flat:
            return
        tail = flat.endswith(" ")
        if self.space and self.words:
            self.words.append(" ")
        self.words.append(flat[:-1] if tail else flat)
        self.space = tail

    def line_end(self, keep_empty: bool = False) -> None:
        line = "".join(self.words).strip(" ")
        self.words, self.space = [], False
        if line or self.prefix.strip():
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append((self.indent + self.prefix + line).rstrip())
            self.prefix = " " * len(self.prefix)
        elif keep_empty and self.done and not self.gap:
            self.done.append("")

    def block(self, spaced: bool) -> None:
        if self.words:
            self.line_end()
        self.gap = self.gap or spaced

    def raw(self, data: str) -> None:
        """Preformatted text: its own lines and spaces."""
        first, *rest = data.split("\n")
        if first:
            self.words.append(first)
        for line in rest:
            out = "".join(self.words)
            self.words = []
            if self.gap and self.done:
                self.done.append("")
            self.gap = False
            self.done.append((self.indent + self.prefix + out).rstrip())
            self.prefix = " " * len(self.prefix)
            if line:
                self.words.append(line)

    def lines(self) -> list[str]:
        if self.words:
            self.line_end()
        while self.done and not self.done[-1]:
            self.done.pop()
        return self.done


def _rows(table: Node) -> list[list[Node]]:
    """Cells by row, in order; stray cells make a row of their own."""
    rows: list[list[Node]] = []
    queue = [(child, False) for child in reversed(table.children)]
    stray = False
    while queue:
        child, _ = queue.pop()
        if isinstance(child, str) or child.hidden:
            continue
        if child.tag in ("tbody", "thead", "tfoot"):
            queue.extend((c, False) for c in reversed(child.children))
        elif child.tag == "tr":
            rows.append([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and not c.hidden])
            stray = False
        elif child.tag in ("td", "th"):
            if not stray:
                rows.append([])
            rows[-1].append(child)
            stray = True
    return [r for r in rows if r]


def _loose(table: Node) -> list:
    """What stands in a table outside of its cells; it is shown before the table."""
    out: list = []
    queue = list(reversed(table.children))
    while queue:
        child = queue.pop()
        if isinstance(child, str):
            out.append(child)
        elif child.tag in ("tbody", "thead", "tfoot", "tr"):
            if not child.hidden:
                queue.extend(reversed(child.children))
        elif child.tag not in ("td", "th", "colgroup"):
            out.append(child)
    return out


def _folded(lines: list[str]) -> list[str]:
    """Lines cut between words where they pass WIDEST; what follows a cut keeps the line's indent."""
    out = []
    for line in lines:
        indent = " " * min(len(line) - len(line.lstrip(" ")), WIDEST // 2)
        while len(line) > WIDEST:
            at = line.rfind(" ", len(indent) + 1, WIDEST + 1)
            if at < 0 or not line[:at].strip(" "):
                at = line.find(" ", WIDEST)
            if at < 0:
                break
            out.append(line[:at].rstrip(" "))
            line = indent + line[at:].lstrip(" ")
        out.append(line)
    return out


def _table(table: Node) -> list[str]:
    placed, held = [], {}  # held: column -> rows that a cell from above still covers
    for row in _rows(table):
        line, column, cover = [], 0, {}
        for cell in row:
            while held.get(column, 0):
                column += 1
            lines = _folded(render(cell.children))
            line.append((column, cell.span[0], lines))
            if cell.span[1] > 1:
                for k in range(column, column + cell.span[0]):
                    cover[k] = cell.span[1]
            column += cell.span[0]
        held = {k: n - 1 for k, n in {**held, **cover}.items() if n > 1}
        placed.append(line)
    widths: dict[int, int] = {}
    for line in placed:
        for column, span, lines in line:
            if span == 1:
                widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= WIDEST), default=0))
    starts, at = {}, 0
    for column in range(max((c for line in placed for c, _, _ in line), default=-1) + 1):
        starts[column] = at
        if column in widths and widths[column]:
            at += widths[column] + 2
    out = []
    for line in placed:
        for k in range(max((len(lines) for _, _, lines in line), default=0)):
            text = ""
            for column, _, lines in line:
                if k < len(lines) and lines[k]:
                    text = text.ljust(starts[column]) if len(text) < starts[column] or not text else text + "  "
                    text += lines[k]
            out.append(text.rstrip())
    return out


def render_tables(root: Node) -> None:
    """Render every table that isn't hidden into its `lines`, inner ones first; so tables may be nested to any depth."""
    tables, queue = [], [root]
    while queue:
        node = queue.pop()
        if node.tag == "table":
            tables.append(node)
        queue.extend(c for c in node.children if isinstance(c, Node) and not c.hidden)
    for table in reversed(tables):  # what is inside a table was met after it
        table.lines = render(_loose(table)) + _table(table)


def render(children: list) -> list[str]:
    """Lines of the visible text of these nodes, in order; tables among them are rendered already."""
    out = Lines()
    pre = 0
    lists: list[list] = []  # [kind, next number]
    stack = [iter(children)]
    leave: list[tuple] = [()]
    while stack:
        for child in stack[-1]:
            if isinstance(child, str):
                if pre:
                    out.raw(child.replace("\r\n", "\n"))
                else:
                    out.text(child)
                continue
            tag = child.tag
            if child.hidden or tag in UNSEEN:
                continue
            if tag == "br":
                if pre:
                    out.raw("\n")
                else:
                    out.line_end(keep_empty=True)
                continue
            if tag == "table":
                out.block(True)
                for line in child.lines:
                    out.words = [line] if line else []
                    if line:
                        kept = out.indent
                        if out.gap and out.done:
                            out.done.append("")
                        out.gap = False
                        out.done.append((kept + out.prefix + line).rstrip())
                        out.prefix = " " * len(out.prefix)
                    out.words = []
                out.block(True)
                continue
            ending: tuple = ()
            if tag in SPACED or tag in PLAIN:
                nested = tag in ("ul", "ol", "menu") and lists
                spaced = tag in SPACED and not nested
                out.block(spaced)
                ending = ("block", spaced)
                if tag == "pre":
                    pre += 1
                    ending = ("pre", spaced)
                elif tag in ("ul", "ol", "menu"):
                    lists.append([tag, 1 if child.number is None else child.number])
                    ending = ("list", spaced, out.indent)
                    if len(lists) > 1:
                        out.indent += "  "
                elif tag == "li":
                    kind = lists[-1] if lists else ["ul", 1]
                    if kind[0] == "ol":
                        kind[1] = kind[1] if child.number is None else child.number
                        mark = f"{kind[1]}. "
                        kind[1] += 1
                    else:
                        mark = "- "
                    ending = ("item", out.prefix)
                    out.prefix = mark if child.shown else ""
                elif tag in ("dd", "blockquote"):
                    ending = ("indent", spaced, out.indent)
                    out.indent += "  "
            if tag in VOID:
                for text in child.children:
                    out.text(text)
                continue
            stack.append(iter(child.children))
            leave.append(ending)
            break
        else:
            stack.pop()
            ending = leave.pop()
            if not ending:
                continue
            kind = ending[0]
            if kind == "item":
                if out.words:
                    out.line_end()
                elif out.prefix.strip():
                    out.line_end()  # an empty item keeps its mark
                out.prefix = ending[1]
                continue
            if kind == "pre" and out.words:
                out.raw("\n")
            out.block(ending[1])
            if kind == "pre":
                pre -= 1
            elif kind == "list":
                lists.pop()
                out.indent = ending[2]
            elif kind == "indent":
                out.indent = ending[2]
    return out.lines()


def html_text(html: str | None) -> str:
    """Visible text; empty for null or empty input. Broken markup is read as far as it goes."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html)
    builder.close()
    render_tables(builder.root)
    return "\n".join(render(builder.root.children))


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, text, n_chars) of pages (page_id, html): one row per input row; null html gives empty text."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, "html"):
            texts = [html_text(h) for h in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"].astype("Int64"), "text": texts, "n_chars": [len(t) for t in texts]})

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "html")
    return slim.mapInPandas(run, "page_id long, text string, n_chars long")
