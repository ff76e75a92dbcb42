"""python -m fathom.cli init|demo|ingest|crawl|stats|health --store PATH ...: the index from a shell."""

from __future__ import annotations

import argparse
import time

from pyspark.sql import functions as F

from fathom.operators import crawl, index, stats
from fathom.schemas import initialize
from fathom.session import build_session
from fathom.sources import tables
from fathom.sources.demo import seed_demo
from fathom.streaming.ingest import ingest_batch


def health(store: index.VersionedStore) -> dict[str, str]:
    """Whether the session answers and the store can be read."""
    out = {}
    for name, test in (("session", lambda: store.spark.range(1).count()), ("store", store.version)):
        try:
            test()
            out[name] = "ok"
        except Exception as e:  # noqa: BLE001
            out[name] = f"{type(e).__name__}: {e}"
    return out


def main(args: list[str] | None = None) -> dict:
    p = argparse.ArgumentParser(prog="fathom")
    p.add_argument("command", choices=("init", "demo", "ingest", "crawl", "stats", "health"))
    p.add_argument("--store", required=True)
    p.add_argument("--pages", help="parquet of fetched pages: url, html, service_name, crawled_at")
    p.add_argument("--links", help="parquet of anchors: page_url, href")
    p.add_argument("--services", nargs="*")
    p.add_argument("--urls-file")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--master", default="local[*]")
    a = p.parse_args(args)
    spark = build_session(a.master)
    store, began = index.VersionedStore(spark, a.store), time.time()
    if a.command == "init":
        out = {"version": initialize(spark, store)}
    elif a.command == "demo":
        out = {"version": seed_demo(store)}
    elif a.command == "health":
        out = health(store)
    elif a.command == "stats":
        documents, chunks = store.read("documents"), store.read("chunks")
        out = {"totals": stats.totals(documents, chunks).first().asDict(), "services": [r.asDict() for r in stats.per_service(documents, chunks).orderBy("service_name").collect()]}
    elif a.command == "crawl":
        seeds = tables.seeds(spark, a.services).select("url")
        if a.urls_file:
            seeds = seeds.unionByName(tables.url_list(spark, a.urls_file))
        found = crawl.reachable(seeds, crawl.resolved_links(spark.read.parquet(a.links)))
        out = {"urls": found.count()}
    else:
        pages = spark.read.parquet(a.pages)
        if a.services:
            pages = pages.where(F.col("service_name").isin([s.lower() for s in a.services]))
        if a.max_pages:
            pages = tables.first_pages(pages, a.max_pages, "url")
        out = {"version": ingest_batch(store, pages), "elapsed": round(time.time() - began, 1)}
    print(out)
    return out


if __name__ == "__main__":
    main()
