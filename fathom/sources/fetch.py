"""Fetching pages: one interface, a plain client, and the plan that runs it over a table of urls."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.tables import Settings, html_responses

FETCHED = "url string, status int, content_type string, html string, error string"


class Fetcher(Protocol):
    """Made once in each task by a factory. ``get`` gives (status, content type, text); what it raises becomes the row's error."""

    def get(self, url: str) -> tuple[int, str, str]: ...


class UrlFetcher:
    """Fetches by http with the standard library. A server's refusal is an answer, not an error."""

    def __init__(self, timeout: float = 30.0, agent: str = "fathom") -> None:
        self.timeout, self.agent = timeout, agent

    def get(self, url: str) -> tuple[int, str, str]:
        from urllib.error import HTTPError
        from urllib.request import Request, urlopen

        try:
            with urlopen(Request(url, headers={"User-Agent": self.agent}), timeout=self.timeout) as answer:
                return answer.status, answer.headers.get("Content-Type", ""), answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except HTTPError as e:
            return e.code, e.headers.get("Content-Type", ""), ""


def fetch(urls: DataFrame, factory=UrlFetcher, rate: float | None = None, burst: int | None = None) -> DataFrame:
    """(url, status, content_type, html, error) of each distinct url. A host's pages are fetched by one task, no faster than
    ``rate`` a second after a first ``burst``; a page that cannot be fetched is an error of its own row."""
    settings = Settings.of(urls.sparkSession)
    rate, burst = settings.crawl_rate if rate is None else rate, settings.crawl_burst if burst is None else burst
    distinct = urls.select("url").where("url IS NOT NULL").distinct()
    by_host = distinct.withColumn("host", F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1)).repartition("host").sortWithinPartitions("host", "url")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetcher, host, tokens, last = factory(), None, 0.0, 0.0
        for part in parts:
            rows = []
            for url, own in zip(part["url"], part["host"]):
                now = time.monotonic()
                if own != host:
                    host, tokens, last = own, float(burst), now
                tokens, last = min(burst, tokens + (now - last) * rate), now
                if tokens < 1:
                    time.sleep((1 - tokens) / rate)
                    tokens, last = 1.0, time.monotonic()
                tokens -= 1
                try:
                    rows.append((url, *fetcher.get(url), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((url, None, None, None, f"{type(e).__name__}: {e}"))
            frame = pd.DataFrame(rows, columns=["url", "status", "content_type", "html", "error"])
            yield frame.astype({"status": "Int32"})

    return by_host.mapInPandas(run, FETCHED)


def fetch_pages(urls: DataFrame, factory=UrlFetcher, rate: float | None = None, burst: int | None = None) -> DataFrame:
    """Of the fetched urls those that are pages: (url, html, content_hash, crawled_at)."""
    pages = html_responses(fetch(urls, factory, rate, burst))
    return pages.select("url", "html", F.sha2("html", 256).alias("content_hash"), F.current_timestamp().alias("crawled_at"))
