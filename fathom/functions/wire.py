"""Decoding of recorded model streams: the text that a stream's events carry, as Columns over whole streams.

Lines that cannot be parsed are skipped; nothing after a stop mark counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Where each format of the public APIs has its text, and what ends it.
CHOICES_SCHEMA = "struct<choices:array<struct<delta:struct<content:string>>>>"
BLOCKS_SCHEMA = "struct<type:string,delta:struct<type:string,text:string>>"
LINES_SCHEMA = "struct<message:struct<content:string>,done:boolean>"


def _data(stream: Column) -> Column:
    """Values of the data lines of an event stream."""
    lines = F.filter(F.split(F.regexp_replace(stream, "\r\n?", "\n"), "\n"), lambda x: x.startswith("data:"))
    return F.transform(lines, lambda x: F.trim(F.substring(x, F.lit(6), F.length(x))))


def _before(values: Column, stop) -> Column:
    """The values before the first one that stops."""
    marks = F.transform(values, lambda x: F.coalesce(stop(x), F.lit(False)))
    first = F.array_position(marks, True)
    return F.when(first > 0, F.slice(values, F.lit(1), F.greatest(first - 1, F.lit(0)))).otherwise(values)


def _joined(parts: Column) -> Column:
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), "")


def choices_text(stream: Column) -> Column:
    """Streams of ``choices[0].delta.content``, ended by ``[DONE]``."""
    values = _before(_data(stream), lambda x: x == "[DONE]")
    return _joined(F.transform(values, lambda x: F.get(F.from_json(x, CHOICES_SCHEMA)["choices"], F.lit(0))["delta"]["content"]))


def blocks_text(stream: Column) -> Column:
    """Streams of ``content_block_delta`` events, ended by ``message_stop``."""
    events = _before(F.transform(_data(stream), lambda x: F.from_json(x, BLOCKS_SCHEMA)), lambda e: e["type"] == "message_stop")
    return _joined(F.transform(events, lambda e: F.when(e["type"] == "content_block_delta", e["delta"]["text"])))


def lines_text(stream: Column) -> Column:
    """Streams of one JSON object a line with ``message.content``; the line that is ``done`` is the last that counts."""
    events = F.transform(F.split(stream, "\n"), lambda x: F.from_json(x, LINES_SCHEMA))
    done = F.array_position(F.transform(events, lambda e: F.coalesce(e["done"], F.lit(False))), True)
    kept = F.when(done > 0, F.slice(events, F.lit(1), done)).otherwise(events)
    return _joined(F.transform(kept, lambda e: e["message"]["content"]))


def answer_of(events: Column) -> Column:
    """The answer that parsed events (array<struct<event, data>>) spell out, and null if an error came."""
    chunks = F.filter(events, lambda e: e["event"] == "chunk")
    failed = F.exists(events, lambda e: e["event"] == "error")
    return F.when(~failed, F.array_join(F.transform(chunks, lambda e: e["data"]), ""))
