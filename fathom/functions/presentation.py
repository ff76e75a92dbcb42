"""Expressions of the presentation layer: shares, buckets, colours, relative times, request fields, event streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PALETTE_SIZE, HEAT_STEPS = 10, 5
TOP_K_DEFAULT, TOP_K_MIN, TOP_K_MAX = 10, 1, 20


def color_index(name: Column) -> Column:
    """A stable place in the palette: a polynomial hash of the characters modulo 2^32."""
    codes = F.transform(F.split(name, ""), lambda c: F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296) % PALETTE_SIZE


def heat(score: Column) -> Column:
    inside = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.least(F.lit(HEAT_STEPS - 1), F.floor(inside * HEAT_STEPS).cast("int"))


def three_decimals(score: Column) -> Column:
    return F.format_string("%.3f", score)


def relative_time(then: Column, now: Column) -> tuple[Column, Column]:
    """(value, unit) of a point in time as seen from another: negative values lie in the past; null gives unit ``unknown``."""
    seconds = (F.unix_micros(now) - F.unix_micros(then)) / 1e6
    diff = F.floor(seconds + 0.5)
    steps = ((60, 1, "second"), (3600, 60, "minute"), (86400, 3600, "hour"), (2592000, 86400, "day"), (31536000, 2592000, "month"))
    value, unit = F.floor(-diff / 31536000 + 0.5), F.lit("year")
    for below, divisor, name in reversed(steps):
        value = F.when(F.abs(diff) < below, F.floor(-diff / divisor + 0.5)).otherwise(value)
        unit = F.when(F.abs(diff) < below, name).otherwise(unit)
    return value, F.when(then.isNull(), "unknown").otherwise(unit)


def clamp_top_k(k: Column) -> Column:
    return F.least(F.lit(TOP_K_MAX), F.greatest(F.lit(TOP_K_MIN), k))


def validate(query: Column, top_k: Column) -> Column:
    """Null for a valid request, else what is wrong with it."""
    return F.when(query.isNull() | (F.trim(query) == ""), "query is required").when(top_k.isNotNull() & ~top_k.between(TOP_K_MIN, TOP_K_MAX), f"top_k must be between {TOP_K_MIN} and {TOP_K_MAX}")


def cache_key(query: Column, top_k: Column, services: Column) -> Column:
    """The same for requests that differ in the query's case or the services' order only."""
    return F.sha2(F.concat_ws("|", F.lower(query), top_k.cast("string"), F.array_join(F.array_sort(services), ",")), 256)


def parse_services(param: Column) -> Column:
    """The services of a comma-separated parameter, blanks dropped; null if none is left."""
    names = F.filter(F.transform(F.split(param, ","), lambda s: F.trim(s)), lambda s: s != "")
    return F.when(F.size(names) > 0, names)


def toggle(selected: Column, service: Column) -> Column:
    return F.when(F.array_contains(selected, service), F.array_remove(selected, service)).otherwise(F.array_append(selected, service))


def sse_event(event: Column, data: Column) -> Column:
    """One server-sent event: a name, a data line for each line of the data (none for null), an empty line."""
    lines = F.when(data.isNull(), "").otherwise(F.concat(F.array_join(F.transform(F.split(data, "\n"), lambda x: F.concat(F.lit("data: "), x)), "\n"), F.lit("\n")))
    return F.concat(F.lit("event: "), event, F.lit("\n"), lines, F.lit("\n"))


def sse_parse(stream: Column) -> Column:
    """array<struct<event, data>> of a stream: comments dropped, one leading blank of a value taken off, data lines joined."""
    text = F.regexp_replace(stream, "\r\n?", "\n")
    blocks = F.filter(F.split(text, "\n\n+"), lambda b: F.trim(b) != "")

    def field(block: Column, name: str) -> Column:
        lines = F.filter(F.split(block, "\n"), lambda x: x.startswith(name + ":"))
        return F.transform(lines, lambda x: F.regexp_replace(F.substring(x, F.lit(len(name) + 2), F.length(x)), "^ ", ""))

    return F.transform(blocks, lambda b: F.struct(F.coalesce(F.try_element_at(field(b, "event"), F.lit(-1)), F.lit("message")).alias("event"), F.array_join(field(b, "data"), "\n").alias("data")))
