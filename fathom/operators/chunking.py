"""Content nodes to chunks: prose packed by paragraphs and sentences, tables by rows, code whole.

A page is parsed and chunked in one Arrow step, as its chunks depend on each other:
packing is a fold over a node's pieces, overlap a fold over the page's chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions.text import CONFIG_PATTERNS
from fathom.sources.html import flatten_page, with_parsed

MAX_TOKENS, OVERLAP, CONTEXT = 512, 50, 100
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
_CONFIG = re.compile("|".join(CONFIG_PATTERNS), re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_ANY_SENTENCE = re.compile(r"(?<=[.!?])\s+")

CHUNK = T.StructType(
    [
        T.StructField("chunk_index", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("chunk_type", T.StringType()),
        T.StructField("section_path", T.StringType()),
        T.StructField("token_count", T.IntegerType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)


def count(text: str) -> int:
    return sum(1 for _ in _TOKEN.finditer(text))


def head(text: str, n: int) -> str:
    spans = list(_TOKEN.finditer(text))
    return text if len(spans) <= n else text[: spans[n - 1].end()] if n > 0 else ""


def tail(text: str, n: int) -> str:
    spans = list(_TOKEN.finditer(text))
    return text if len(spans) <= n else text[spans[-n].start() :] if n > 0 else ""


def pack(pieces: list[str], budget: int, joiner: str) -> Iterator[str]:
    """Pieces in order, joined while they fit; a piece over the budget stands alone. Joiners are not counted."""
    held, used = [], 0
    for piece in pieces:
        n = count(piece)
        if held and used + n > budget:
            yield joiner.join(held)
            held, used = [], 0
        held.append(piece)
        used += n
    if held:
        yield joiner.join(held)


def prose(text: str, path: str, limit: int = MAX_TOKENS) -> list[str]:
    """Bodies of the chunks of a prose node: paragraphs packed, one over the budget cut into sentences by itself."""
    budget = limit - count(f"[{path}] " if path else "")
    bodies: list[str] = []
    run: list[str] = []
    for paragraph in filter(None, map(str.strip, text.split("\n\n"))):
        if count(paragraph) > budget:
            bodies.extend(pack(run, budget, "\n\n"))
            run = []
            bodies.extend(pack(_SENTENCE.split(paragraph), budget, " "))
        else:
            run.append(paragraph)
    bodies.extend(pack(run, budget, "\n\n"))
    return bodies


def table(text: str, path: str, limit: int = MAX_TOKENS) -> list[str]:
    """Bodies of the chunks of a table: whole if it fits, else packed rows under its first two lines."""
    prefix = f"[{path}] " if path else ""
    lines = text.strip().split("\n")
    if count(prefix + text) <= limit or len(lines) < 3:
        return [text]
    top = "\n".join(lines[:2])
    return [f"{top}\n{rows}" for rows in pack(lines[2:], limit - count(prefix + top), "\n")]


def context(paragraph: str, limit: int = CONTEXT) -> str:
    whole = paragraph.strip()
    if count(whole) <= limit:
        return whole
    return head(_ANY_SENTENCE.split(whole)[-1].strip(), limit)


def chunk_nodes(title: str | None, nodes: list, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple]:
    """Chunks of a page's flat nodes in order, as rows of ``CHUNK``."""
    out: list[list] = []
    before: dict[int, str] = {}  # the latest paragraph of each section
    for _, _, parent, kind, text, _, language, note, headings in nodes:
        path = " > ".join(h[0] for h in headings)
        prefix = f"[{path}] " if path else ""
        if kind == "paragraph":
            before[parent] = text
        if kind in ("paragraph", "list", "admonition"):
            bodies = prose(f"{note}: {text}" if kind == "admonition" else text, path, limit)
            out.extend([prefix, b, "prose", path, {}] for b in bodies)
        elif kind == "table":
            out.extend([prefix, b, "table", path, {}] for b in table(text, path, limit))
        elif kind == "code" and text.strip():
            told = context(before.get(parent, ""))
            lead = f"Context: {told}\n" if told else ""
            out.append([lead + prefix, f"```{language or ''}\n{text}\n```", "config" if _CONFIG.search(text) else "code", path, {"language": language or ""}])
    if overlap > 0:
        for a, b in zip(out, out[1:]):
            if a[2] == b[2] == "prose" and a[3] == b[3]:
                repeated = tail(a[1], overlap).strip()
                if repeated:
                    b[1] = f"...{repeated}... {b[1]}"
    return [(i, prefix + body, kind, path, count(prefix + body), meta) for i, (prefix, body, kind, path, meta) in enumerate(out)]


def chunk_pages(pages: DataFrame, html_col: str = "html", limit: int = MAX_TOKENS, overlap: int = OVERLAP, sep: str = " ", parser: Callable[[str | None, str], tuple] = flatten_page) -> DataFrame:
    """The pages with (ok, error, title, chunks): parsed and chunked in one Arrow step, each page by itself.

    ``parser`` makes (ok, error, title, flat nodes) of a page and the string that joins inline elements.
    """
    kind = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType()), T.StructField("title", T.StringType()), T.StructField("chunks", T.ArrayType(CHUNK))])

    def parse(html: str | None) -> tuple:
        ok, error, title, nodes = parser(html, sep)
        try:
            return ok, error, title, [(*c[:5], list(c[5].items())) for c in chunk_nodes(title, nodes, limit, overlap)]
        except Exception as e:  # noqa: BLE001
            return False, f"{type(e).__name__}: {e}", title, []

    return with_parsed(pages, html_col, kind, parse)


def exploded(chunked: DataFrame, *keep: str) -> DataFrame:
    return chunked.select(*keep, "title", F.inline("chunks"))


def run_statistics(chunked: DataFrame) -> DataFrame:
    """(crawled, skipped, errored, chunks): pages that gave chunks, that gave none, that failed."""
    size = F.size("chunks")
    return chunked.agg(F.count_if(F.col("ok") & (size > 0)).alias("crawled"), F.count_if(F.col("ok") & (size == 0)).alias("skipped"), F.count_if(~F.col("ok")).alias("errored"), F.coalesce(F.sum(size), F.lit(0)).alias("chunks"))
