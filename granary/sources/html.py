"""HTML to elements: the one place where trees are parsed, in Python by Arrow batches of some pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.session import in_batches

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN = {"script", "style", "template"}
SECTIONAL = ("h1", "h2", "h3", "h4", "p", "li")
FRAME_CHARS = 1 << 18  # of pages whose rows go back together


class _Tree(HTMLParser):
    """Nodes as [tag, attributes, children]; unmatched end tags are ignored, void elements have no children."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", {}, []]
        self.path = [self.root]

    def handle_starttag(self, tag, attrs):
        node = [tag, dict(attrs), []]
        self.path[-1][2].append(node)
        if tag not in VOID:
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self.path[-1][2].append([tag, dict(attrs), []])

    def handle_endtag(self, tag):
        for i in range(len(self.path) - 1, 0, -1):
            if self.path[i][0] == tag:
                del self.path[i:]
                return

    def handle_data(self, data):
        self.path[-1][2].append(data)


def _walk(node: list) -> Iterator[list]:
    """All elements below node in document order, without recursion."""
    stack = [iter(node[2])]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, list):
            yield child
            stack.append(iter(child[2]))


def _text(node: list) -> str:
    out, stack = [], [iter(node[2])]
    while stack:
        child = next(stack[-1], None)
        if child is None:
            stack.pop()
        elif isinstance(child, str):
            out.append(child)
        elif child[0] not in HIDDEN:
            stack.append(iter(child[2]))
    return " ".join(" ".join(out).split())


def sectional_elements(html: str | None, body: tuple[str, ...] = ("main", "article")) -> tuple[str, list[tuple[int, str, str]]] | None:
    """The body's name, and (index, tag, text) of headings, paragraphs and items of the first body found; None if there is none."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    for name in body:
        for node in _walk(tree.root):
            if node[0] == name or name.startswith("#") and node[1].get("id") == name[1:]:
                return name, [(i, x[0], _text(x)) for i, x in enumerate(n for n in _walk(node) if n[0] in SECTIONAL)]
    return None


def _frames(batches: Iterator[pd.DataFrame], read: Callable[[object, str | None], list[tuple]], columns: list[str]) -> Iterator[pd.DataFrame]:
    """The rows that read gives of pages (key, html), those of a few pages at a time."""
    frame = lambda rows: pd.DataFrame(rows, columns=columns).astype({"element_index": "Int32"})
    for batch in batches:
        rows, chars = [], 0
        for k, h in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
            rows += read(k, h)
            chars += len(h or "")
            if chars >= FRAME_CHARS:
                yield frame(rows)
                rows, chars = [], 0
        if rows:
            yield frame(rows)


def elements(pages: DataFrame, key: str, html: str = "html", body: tuple[str, ...] = ("#block-body", "main", "article")) -> DataFrame:
    """(key, element_index, tag, text, body, error) of each page's sectional elements with text.

    A page without a body, or whose body has no such text, gives one row of nulls with an error and empty text.
    """

    def read(k, h):
        name, found = sectional_elements(h, body) or (None, [])
        held = [(k, *e, name, None) for e in found if e[2]]
        return held or [(k, None, None, "", name, "no body was found" if name is None else "the body is empty")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(batches, read, [key, "element_index", "tag", "text", "body", "error"])

    kind = pages.schema[key].dataType.simpleString()
    return in_batches(pages).select(key, F.col(html)).mapInPandas(run, f"{key} {kind}, element_index int, tag string, text string, body string, error string")


def _fits(node: list, simple: str) -> bool:
    """Whether an element is `#id`, `.class` or a tag."""
    if simple[0] == "#":
        return node[1].get("id") == simple[1:]
    if simple[0] == ".":
        return simple[1:] in (node[1].get("class") or "").split()
    return node[0] == simple


def _selected(root: list, selector: str) -> list[list]:
    """Elements that a descendant selector of simple parts picks, each once."""
    held = [root]
    for simple in selector.split():
        held = list({id(n): n for parent in held for n in _walk(parent) if _fits(n, simple)}.values())
    return held


def body_children(html: str | None, selector: str) -> tuple[int, list[tuple[int, str, list[str], str, list[str]]]]:
    """How many bodies there are, and of a single one the child tags as (index, tag, classes, text, texts of refs)."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    bodies = _selected(tree.root, selector)
    if len(bodies) != 1:
        return len(bodies), []
    tags = [n for n in bodies[0][2] if isinstance(n, list)]
    return 1, [(i, n[0], (n[1].get("class") or "").split(), _text(n), [_text(r) for r in _walk(n) if r[0] == "ref"]) for i, n in enumerate(tags)]


def rule_elements(pages: DataFrame, key: str, html: str = "html", selector: str = "#block-body .field--name-body") -> DataFrame:
    """(key, element_index, tag, classes, text, refs, error): the body's child tags, empty ones counted.

    A page without exactly one body gives one row of nulls with an error and empty text.
    """

    def read(k, h):
        n, found = body_children(h, selector)
        return [(k, *e, None) for e in found] if n == 1 else [(k, None, None, None, "", None, f"expected one body, found {n}")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames(batches, read, [key, "element_index", "tag", "classes", "text", "refs", "error"])

    kind = pages.schema[key].dataType.simpleString()
    return in_batches(pages).select(key, F.col(html)).mapInPandas(run, f"{key} {kind}, element_index int, tag string, classes array<string>, text string, refs array<string>, error string")
