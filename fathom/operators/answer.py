"""From ranked chunks to a cited answer: prompt, providers, citations, blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.functions import text as X

SYSTEM_PROMPT = "Answer the question from the numbered context only. Cite the numbers in square brackets, as in [1]. Say so if the context does not hold the answer. Format the answer in Markdown."
NOTHING_FOUND = "No matching documentation was found for this question."


def context_block(rank: Column, service: Column, title: Column, section: Column, url: Column, text: Column) -> Column:
    named = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("**Section:** "), section, F.lit("\n"))).otherwise("")
    head = F.concat(F.lit("### ["), rank.cast("string"), F.lit("] "), F.coalesce(service, F.lit("")), F.lit(" — "), F.coalesce(title, F.lit("")), F.lit("\n"))
    return F.concat(head, named, F.lit("**Source:** "), F.coalesce(url, F.lit("")), F.lit("\n\n"), F.coalesce(text, F.lit("")), F.lit("\n\n---\n\n"))


def prompts(ranked: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, system, user) for each request (query_id, query), from its ranked, enriched chunks."""
    blocks = ranked.select("query_id", "rank", context_block(F.col("rank"), F.col("service_name"), F.col("title"), F.col("section_path"), F.col("url"), F.col("text")).alias("block"))
    context = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x.block), "").alias("context"))
    user = F.concat(F.lit("## Retrieved Context\n\n"), F.coalesce("context", F.lit("")), F.lit("## Question\n\n"), F.col("query"))
    return requests.select("query_id", "query").join(context, "query_id", "left").select("query_id", F.lit(SYSTEM_PROMPT).alias("system"), user.alias("user"))


def reference_numbers(answer: Column) -> Column:
    """The numbers of ``[N]`` marks in the order of their first appearance."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(numbers, lambda x: x.isNotNull() & (x >= 1)))


def citations(answers: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, cite_no, ref_num, chunk_id, url, title, service_name, section_path, text, score): the chunks that an answer
    (query_id, answer) cites, in its order; numbers that no chunk has are left out. ref_num is the number in the prompt."""
    named = answers.select("query_id", F.posexplode(reference_numbers(F.col("answer"))).alias("place", "ref_num"))
    joined = named.join(ranked.withColumnRenamed("rank", "ref_num"), ["query_id", "ref_num"])
    from pyspark.sql.window import Window

    cite_no = F.row_number().over(Window.partitionBy("query_id").orderBy("place"))
    return joined.select("query_id", cite_no.alias("cite_no"), "ref_num", "chunk_id", "url", "title", "service_name", "section_path", X.preview(F.col("text")).alias("text"), "score")


class AnswerProvider(Protocol):
    def complete(self, system: str, user: str) -> str: ...

    def stream(self, system: str, user: str) -> Iterator[str]: ...


class ExtractiveProvider:
    """Answers with the first sentence of the leading context blocks, each with its number. Needs no service."""

    model = "extractive"

    def __init__(self, blocks: int = 3) -> None:
        self.blocks = blocks

    def stream(self, system: str, user: str) -> Iterator[str]:
        context = user.split("## Question\n\n")[0]
        for number, body in re.findall(r"(?ms)^### \[(\d+)\] .*?\n\n(.*?)\n\n---\n", context)[: self.blocks]:
            sentence = re.split(r"(?<=[.!?])\s+", re.sub(r"^\[[^\]]*\] ", "", body.strip()))[0]
            yield f"{sentence} [{number}]\n"

    def complete(self, system: str, user: str) -> str:
        return "".join(self.stream(system, user)).rstrip("\n") or NOTHING_FOUND


def answer(prompt: DataFrame, factory=ExtractiveProvider) -> DataFrame:
    """(query_id, answer, ok, error): a provider that fails costs its own row only."""
    schema = T.StructType([T.StructField("answer", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(schema)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        provider = factory()
        for systems, users in parts:
            rows = []
            for s, u in zip(systems, users):
                try:
                    rows.append((provider.complete(s, u), True, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((None, False, str(e)))
            yield pd.DataFrame(rows, columns=["answer", "ok", "error"])

    return prompt.select("query_id", run("system", "user").alias("r")).select("query_id", "r.*")


BLOCK = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("text", T.StringType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("lang", T.StringType()), T.StructField("level", T.IntegerType())])
)
_LINE = re.compile(r"^\s*```(?P<fence>.*)$|^(?P<marks>#{1,4})\s+(?P<head>.*)$|^\s*[-*]\s+(?P<ul>.*)$|^\s*\d+[.)]\s+(?P<ol>.*)$|^(?P<blank>\s*)$")


def parse_blocks(source: str | None) -> list[tuple]:
    """Blocks of a Markdown-like answer: p, ul, ol, code and h. A fence that is not closed runs to the end."""
    out: list[tuple] = []
    kind, held, lang = None, [], None

    def close() -> None:
        nonlocal kind, held, lang
        if kind == "code":
            out.append(("code", "\n".join(held), None, lang, None))
        elif kind in ("ul", "ol"):
            out.append((kind, None, held, None, None))
        elif kind == "p" and "\n".join(held).strip():
            out.append(("p", "\n".join(held).strip(), None, None, None))
        kind, held, lang = None, [], None

    def put(as_kind: str, line: str) -> None:
        nonlocal kind
        if kind != as_kind:
            close()
            kind = as_kind
        held.append(line)

    for line in (source or "").split("\n"):
        if kind == "code":
            if re.match(r"^\s*```\s*$", line):
                close()
            else:
                held.append(line)
            continue
        m = _LINE.match(line)
        found = m.groupdict() if m else {}
        if found.get("fence") is not None:
            close()
            kind, lang = "code", found["fence"].strip() or None
        elif found.get("marks"):
            close()
            out.append(("h", found["head"].strip(), None, None, len(found["marks"])))
        elif found.get("ul") is not None:
            put("ul", found["ul"])
        elif found.get("ol") is not None:
            put("ol", found["ol"])
        elif found.get("blank") is not None:
            close()
        else:
            put("p", line)
    close()
    return out


@F.pandas_udf(BLOCK)
def markdown_blocks(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(parse_blocks)


def inline_marks(text: Column) -> Column:
    """Numbers of ``[N]`` marks outside code spans, in order, repeated ones too."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(text, "`[^`]+`", " "), F.lit(r"\[([0-9]+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
