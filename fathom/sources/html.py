"""Web pages to content nodes.

One Arrow step parses a page into a small tree of elements and returns its content in
document order as an array of flat nodes, each with its headings; everything after that
is columns.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Where a page's main content stands, in order of preference, as (kind, value).
MAIN_SELECTORS = (("id", "main-col-body"), ("class", "awsdocs-container"), ("main", "main"), ("tag", "main"), ("id", "main-content"), ("tag", "article"))
#: Elements and classes that are not content.
STRIP_TAGS = frozenset(("nav", "footer", "script", "style", "noscript", "svg", "iframe"))
STRIP_CLASSES = frozenset(
    ("awsdocs-nav", "awsdocs-sidebar", "awsdocs-breadcrumb", "awsdocs-page-header-container", "awsdocs-footer", "feedbackYesNoDiv", "page-loading-indicator", "awsui-app-layout__navigation", "awsui-app-layout__tools")
)
#: Classes of notes, names of languages, what titles end with.
NOTE_CLASSES = frozenset(("awsdocs-note", "awsdocs-warning", "awsdocs-important", "awsdocs-tip", "note", "warning", "important", "tip"))
LANGUAGES = ("json", "yaml", "xml", "python", "bash", "shell", "java", "go")
TITLE_SUFFIXES = (" - Amazon", " - AWS", " — Amazon", " — AWS")
#: Elements whose content is looked into; other elements that are not content blocks are left out with their text.
OPEN_TAGS = frozenset(("div", "section", "article", "main", "span", "a", "em", "strong", "b", "i"))

_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_BLOCKS = frozenset(("address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"))
_CLOSES = {"li": (("li",), ("ul", "ol")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)), "option": (("option",), ("select",))}
_P_STOPS = ("td", "th", "li", "div", "section", "article", "main", "aside", "body")

HEADING = T.StructType([T.StructField("text", T.StringType()), T.StructField("level", T.IntegerType())])
NODE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("depth", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("node_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("language", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("headings", T.ArrayType(HEADING)),
    ]
)
PAGE = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("title", T.StringType()), T.StructField("nodes", T.ArrayType(NODE))])


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]) -> None:
        self.tag, self.attrs, self.children = tag, attrs, []

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            yield e
            stack.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def strings(self) -> Iterator[str]:
        stack: list = [self]
        while stack:
            e = stack.pop()
            if isinstance(e, str):
                yield e
            else:
                stack.extend(reversed(e.children))

    def text(self, sep: str) -> str:
        return sep.join(t for t in (s.strip() for s in self.strings()) if t)

    def first(self, test) -> Element | None:
        return next((e for e in self.walk() if e is not self and test(e)), None)


class _Builder(HTMLParser):
    """Elements end where their parent ends, where a sibling of their kind begins, or, for p, where a block begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#page", {})
        self.open = [self.root]

    def _end(self, tags: tuple[str, ...], stops: tuple[str, ...]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stops:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self._end(("p",), _P_STOPS)
        if tag in _CLOSES:
            self._end(*_CLOSES[tag])
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse_html(html: str) -> Element:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def main_element(page: Element) -> Element:
    everything = list(page.walk())
    for kind, value in MAIN_SELECTORS:
        for e in everything:
            if kind == "id" and e.attrs.get("id") == value or kind == "class" and value in e.classes or kind == "tag" and e.tag == value or kind == "main" and e.tag == "main" and e.attrs.get("role") == value:
                return e
    return next((e for e in everything if e.tag == "body"), page)


def strip_chrome(e: Element) -> None:
    kept = [c for c in e.children if not isinstance(c, Element) or c.tag not in STRIP_TAGS and not STRIP_CLASSES.intersection(c.classes)]
    e.children = kept
    for c in kept:
        if isinstance(c, Element):
            strip_chrome(c)


def page_title(page: Element, main: Element) -> str:
    title = page.first(lambda e: e.tag == "title")
    if title is not None and "".join(title.strings()).strip():
        text = "".join(title.strings()).strip()
        cut = next((s for s in TITLE_SUFFIXES if s in text), None)
        return text.split(cut)[0].strip() if cut else text
    h1 = main.first(lambda e: e.tag == "h1")
    return h1.text(" ") if h1 is not None else ""


def code_language(e: Element, code: str) -> str:
    """By class names, then by looks."""
    holder = e.first(lambda x: x.tag == "code") or e
    for name in holder.classes:
        m = re.match(r"lang(?:uage)?-(.*)", name)
        if m:
            return m[1]
        known = next((x for x in LANGUAGES if x in name.lower()), None)
        if known:
            return known
    if code[:1] in "{[" and code:
        try:
            json.loads(code)
            return "json"
        except ValueError:
            pass
    if code.startswith("---") or re.match(r"\w+:\s", code):
        return "yaml"
    if code.startswith("<") and "</" in code:
        return "xml"
    return "bash" if code.startswith(("$ ", "# ", "aws ", "sudo ")) else ""


def table_markdown(e: Element, sep: str) -> str:
    rows = [[c.text(sep).replace("|", "\\|") for c in tr.walk() if c.tag in ("td", "th")] for tr in e.walk() if tr.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    rows = [r + [""] * (width - len(r)) for r in rows]
    return "\n".join("| " + " | ".join(r) + " |" for r in (rows[0], ["---"] * width, *rows[1:]))


def list_text(e: Element, sep: str, indent: int = 0) -> str:
    lines = []
    for number, li in enumerate((c for c in e.children if isinstance(c, Element) and c.tag == "li"), 1):
        nested = [c for c in li.children if isinstance(c, Element) and c.tag in ("ul", "ol")]
        own = [c.strip() if isinstance(c, str) else c.text(sep) for c in li.children if not any(c is n for n in nested)]
        lines.append("  " * indent + ("- " if e.tag == "ul" else f"{number}. ") + " ".join(t for t in own if t))
        lines.extend(list_text(n, sep, indent + 1) for n in nested)
    return "\n".join(lines)


class _Flattener:
    """Content in document order. A heading opens a section that lasts until one of its level or above."""

    def __init__(self, title: str, sep: str) -> None:
        self.sep, self.nodes = sep, []
        self.sections = [(-1, 0)]  # (node number, level) of the open sections; -1 is the page
        self.headings = [(title, 0)] if title else []
        self.loose = False  # whether bare text may join the paragraph before it

    def add(self, kind: str, text: str, level: int | None = None, language: str | None = None, title: str | None = None) -> None:
        parent = self.sections[-1][0]
        self.nodes.append([len(self.nodes), len(self.sections), parent, kind, text, level, language, title, list(self.headings)])

    def heading(self, text: str, level: int) -> None:
        while len(self.sections) > 1 and self.sections[-1][1] >= level:
            self.sections.pop()
        while self.headings and self.headings[-1][1] >= level:
            self.headings.pop()
        self.headings.append((text, level))
        self.add("section", text, level)
        self.sections.append((self.nodes[-1][0], level))

    def bare(self, text: str) -> None:
        last = self.nodes[-1] if self.nodes else None
        if last is not None and last[3] == "paragraph" and last[2] == self.sections[-1][0]:
            last[4] += " " + text
        else:
            self.add("paragraph", text)

    def visit(self, e: Element) -> None:
        for c in e.children:
            if isinstance(c, str):
                if c.strip():
                    self.bare(c.strip())
                continue
            tag, classes = c.tag, c.classes
            if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
                text = c.text(self.sep)
                if tag != "h1" and text:
                    self.heading(text, int(tag[1]))
            elif tag == "pre" or tag == "div" and "code" in classes:
                code = "".join(c.strings()).strip()
                if code:
                    self.add("code", code, language=code_language(c, code))
            elif tag == "table":
                text = table_markdown(c, self.sep)
                if text:
                    self.add("table", text)
            elif tag == "div" and NOTE_CLASSES.intersection(classes):
                named = c.first(lambda x: any(re.search("title|heading", n, re.I) for n in x.classes))
                title = named.text(self.sep) if named is not None else "Note"
                if named is not None:
                    for x in c.walk():
                        x.children = [y for y in x.children if y is not named]
                self.add("admonition", c.text(self.sep), title=title)
            elif tag in ("ul", "ol"):
                text = list_text(c, self.sep)
                if text.strip():
                    self.add("list", text)
            elif tag == "p":
                text = c.text(self.sep)
                if text:
                    self.add("paragraph", text)
            elif tag in OPEN_TAGS:
                self.visit(c)


def flatten_page(html: str | None, sep: str = " ") -> tuple:
    """(ok, error, title, nodes) of one page; a page that cannot be read is an error of its own row. Null html is empty."""
    try:
        page = parse_html(html or "")
        main = main_element(page)
        strip_chrome(main)
        title = page_title(page, main)
        flat = _Flattener(title, sep)
        flat.visit(main)
        return True, None, title, [tuple(n) for n in flat.nodes]
    except Exception as e:  # noqa: BLE001
        return False, f"{type(e).__name__}: {e}", None, []


def with_parsed(df: DataFrame, html_col: str, schema: T.StructType, parse: Callable[[str | None], tuple]) -> DataFrame:
    """The rows with the fields of ``schema`` that ``parse`` makes of each page, built as Arrow arrays at once."""
    out = T.StructType([*df.schema.fields, *schema.fields])
    at = df.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                rows = [parse(h) for h in part.column(at).to_pylist()]
                fields = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds.types)]
                yield pa.RecordBatch.from_arrays([*part.columns, *fields], names=out.names)

    return df.mapInArrow(run, out)


def flatten_html(df: DataFrame, html_col: str = "html", sep: str = " ") -> DataFrame:
    """The rows with (ok, error, title, nodes). ``sep`` joins the strings of inline elements."""
    return with_parsed(df, html_col, PAGE, lambda h: flatten_page(h, sep))


def outline(nodes):
    """An indented line of at most 60 characters for each node."""
    return F.transform(nodes, lambda n: F.concat(F.repeat(F.lit("  "), n.depth), F.lit("["), n.node_type, F.lit("] "), F.left(F.regexp_replace(n.text, r"\s+", " "), F.lit(60))))
