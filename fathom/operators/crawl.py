"""Breadth-first crawl over a table of links."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.functions import urls as U
from fathom.session import materialize

#: Levels after which what was seen is written as one table, so that the plan of a deep crawl stays short.
MERGE_LEVELS = 16


def resolved_links(links: DataFrame) -> DataFrame:
    """(src, dst): normal forms of the pages and of the urls that their anchors lead to; each pair once.

    Distinct pairs come first: a link in every page of a site is resolved once per page, not once per anchor.
    """
    raw = links.where(U.followable(F.col("href")) & F.col("page_url").isNotNull()).select("page_url", "href").distinct()
    return raw.select(U.normalize(F.col("page_url")).alias("src"), U.normalize(U.resolve("page_url", "href")).alias("dst")).where("dst IS NOT NULL AND dst != ''").distinct()


def in_scope(df: DataFrame, prefixes: DataFrame, url_col: str) -> DataFrame:
    """Rows whose url begins with a prefix (column ``prefix``). Prefixes are joined by their host, then compared."""
    host = lambda c: F.regexp_extract(c, r"^([a-zA-Z][\w+.-]*://[^/]*)", 1)
    scoped = prefixes.select("prefix", host(F.col("prefix")).alias("_host")).distinct()
    with_host = df.withColumn("_host", host(F.col(url_col)))
    return with_host.join(scoped, (with_host["_host"] == scoped["_host"]) & F.startswith(with_host[url_col], scoped["prefix"]), "left_semi").drop("_host")


def reachable(seeds: DataFrame, links: DataFrame, prefixes: DataFrame | None = None, max_depth: int | None = None) -> DataFrame:
    """(url, depth): what a crawl from the seeds comes to, by the least number of links.

    links: (src, dst). Links out of scope and urls to skip are not followed; seeds always are. Each level is one join
    of the frontier with the links and one anti join with what was seen, written to the shared folder. The crawl ends
    when a level finds nothing new; with ``max_depth`` it raises if pages beyond it remain.
    """
    edges = links.where(~U.skipped(F.col("dst")))
    if prefixes is not None:
        edges = in_scope(edges, prefixes, "dst")
    edges = materialize(edges.select("src", "dst"), "links")
    seen = frontier = materialize(seeds.select(F.col("url")).where("url IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "frontier")
    for depth in itertools.count(1):
        fresh = edges.join(frontier.select(F.col("url").alias("src")), "src", "left_semi").select(F.col("dst").alias("url")).distinct()
        frontier = materialize(fresh.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if not frontier.take(1):
            return seen
        if max_depth is not None and depth > max_depth:
            raise RuntimeError(f"pages more than {max_depth} links from the seeds remain")
        seen = seen.unionByName(frontier)
        if depth % MERGE_LEVELS == 0:
            seen = materialize(seen, "seen")
