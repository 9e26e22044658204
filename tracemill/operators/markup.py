"""Sections and table rows of HTML pages, read from a small tree.

A page is parsed into a tree first: void elements never hold anything, an end tag closes the nearest open element of its name (or
nothing), and an element whose end may be left out is closed by what can't stand inside it. Everything else is
asked of the tree, so a stray or missing end tag changes the place of a text, never what follows it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- Fixed values: elements without content, and elements that a start tag closes if they are open (within the nearest of the bounds).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "ul", "ol", "table", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "section", "article", "form", "hr", "dl"}
CLOSED_BY = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "p": _BLOCKS | {"li", "td", "th", "tr"}}
BOUNDS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
TABLE = {"table"}
# --- Fixed values: headings that open a section, elements whose own text counts, and how a section of the rule is cited.
HEADINGS = {"h1", "h2", "h3"}
TEXT_HOLDERS = {"p", "li", "td", "th", "div", "span"}
CITED = re.compile(r"(?:21\s*CFR\s*)?1\.\d{4}", re.I)
RAW = {"script", "style", "template", "noscript"}


class Node:
    """An element: its name, attributes, and children, which are nodes or strings."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str | None] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__()
        self.path = [Node("#page")]

    def handle_starttag(self, tag, attrs):
        self._imply(tag)
        node = Node(tag, dict(attrs))
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for depth in range(len(self.path) - 1, 0, -1):
            if self.path[depth].name == tag:
                del self.path[depth:]
                return

    def handle_data(self, data):
        self.path[-1].children.append(data)

    def _imply(self, tag: str) -> None:
        """Close what can't hold this element: looked for from the innermost open one up to a bound."""
        for depth in range(len(self.path) - 1, 0, -1):
            name = self.path[depth].name
            if tag in CLOSED_BY.get(name, ()):
                del self.path[depth:]
            elif name in BOUNDS.get(tag, TABLE) or name in TABLE:
                return


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.path[0]


def walk(node: Node) -> Iterator[tuple[Node, Node | str]]:
    """(parent, child) of everything below, in order of the page; no recursion, as pages may be nested deeply."""
    stack = [(node, iter(node.children))]
    while stack:
        parent, rest = stack[-1]
        for child in rest:
            yield parent, child
            if isinstance(child, Node):
                stack.append((child, iter(child.children)))
                break
        else:
            stack.pop()


def squeezed(text: str) -> str:
    return " ".join(text.split())


def full_text(node: Node) -> str:
    return squeezed(" ".join(c for p, c in walk(node) if isinstance(c, str) and p.name not in RAW))


def sections_of(html: str | None) -> list[tuple[str, str, str]]:
    """(label, section, text) of a page.

    A heading of the first three levels starts a section and its whole text is the label; an empty heading ends a section and keeps the label. Of what follows, the
    text that stands directly in a paragraph, item, cell, div or span counts. A section is named by the first place of the rule
    that its label or text cites, else by its label. Text before any heading is labelled Document; a page without such
    text is one section of its bare text, and null html an empty one.
    """
    page = tree(html)
    label, parts, found, in_heading = "Document", [], [], set()

    def finish():
        if parts:
            text = " ".join(parts)
            cited = CITED.search(f"{label} {text}")
            found.append((label, cited.group(0) if cited else label, text))
            parts.clear()

    for parent, child in walk(page):
        if isinstance(child, Node):
            if id(parent) in in_heading:
                in_heading.add(id(child))
            elif child.name in HEADINGS:
                in_heading.add(id(child))
                finish()
                label = full_text(child) or label
        elif parent.name in TEXT_HOLDERS and id(parent) not in in_heading and (text := squeezed(child)):
            parts.append(text)
    finish()
    return found or [("Document", "document", full_text(page))]


def html_sections(pages: DataFrame) -> DataFrame:
    """(page_id, ordinal, section_label, section, text) of pages (page_id, html), as sections_of has them; ordinals count from 1."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, *s) for i, html in zip(frame["page_id"], frame["html"], strict=True) for k, s in enumerate(sections_of(html), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "ordinal", "section_label", "section", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ordinal int, section_label string, section string, text string")


def rows_of(html: str | None) -> list[tuple[list[str], list[str]]]:
    """(texts of the cells, targets of the links) of every table row that has cells; a table inside a cell has rows of its own."""
    found: dict[int, tuple[list[str], list[str]]] = {}
    cell_of: dict[int, tuple[list[str], list[str]]] = {}  # the row that an element's text belongs to, by the element
    for parent, child in walk(tree(html)):
        row = cell_of.get(id(parent))
        if isinstance(child, str):
            if row and (text := squeezed(child)):
                row[0][-1] = f"{row[0][-1]} {text}".strip()
        elif child.name == "tr":
            found[id(child)] = ([], [])
        elif child.name in ("td", "th") and id(parent) in found:
            found[id(parent)][0].append("")
            cell_of[id(child)] = found[id(parent)]
        elif row and child.name != "table":
            cell_of[id(child)] = row
            if child.name == "a" and child.attrs.get("href"):
                row[1].append(child.attrs["href"])
    return [r for r in found.values() if r[0]]


def rules_rows(pages: DataFrame) -> DataFrame:
    """(page_id, row_number, title, docket, links) of the table rows of rule listings; the docket is the first one named in the row, header rows go."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, k, *r) for i, html in zip(frame["page_id"], frame["html"], strict=True) for k, r in enumerate(rows_of(html), 1)]
            yield pd.DataFrame(rows, columns=["page_id", "row_number", "cells", "links"])

    rows = pages.select("page_id", "html").mapInPandas(run, "page_id long, row_number int, cells array<string>, links array<string>")
    docket = F.nullif(F.regexp_extract(F.array_join("cells", " "), r"(FDA-\d{4}-[A-Z]-\d{4})", 1), F.lit(""))
    return rows.filter(docket.isNotNull()).select("page_id", "row_number", F.get("cells", F.lit(0)).alias("title"), docket.alias("docket"), "links")
