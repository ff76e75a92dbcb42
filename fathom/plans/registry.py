"""All queries of the core, by name, and the SQL each is checked against."""

from __future__ import annotations

from fathom.plans import common, ingest, parsing, retrieval, serve  # noqa: F401


def queries() -> dict:
    return dict(common.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(common.SQL)
