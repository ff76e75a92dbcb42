"""Structured Streaming: page ingest by micro-batches, per-key token buckets, windowed counts of late data."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fathom.operators import index
from fathom.operators.chunking import chunk_pages, exploded
from fathom.operators.embed import HashingEmbedder, embed
from fathom.operators.serving import BURST, IDLE, RATE, token_bucket
from fathom.sources.tables import Settings


def ingest_batch(store: index.VersionedStore, pages: DataFrame, factory=None) -> int | None:
    """One batch of fetched pages into the store: changed pages only, state moved in the same version. None if nothing changed."""
    newest = index.newest(pages.where("url IS NOT NULL").withColumn("content_hash", F.sha2("html", 256)).select("url", "crawled_at", "content_hash", "html", "service_name"), "url", "crawled_at", "content_hash")
    known = store.read("crawl_state", newest)
    fresh = newest if known is None else index.changed(newest, known)
    settings = Settings.of(store.spark)
    parsed = chunk_pages(fresh, limit=settings.chunk_tokens, overlap=settings.overlap_tokens).where("ok AND size(chunks) > 0").withColumn("doc_id", index.document_id("url")).persist()
    try:
        if not parsed.take(1):
            return None
        now = F.current_timestamp()
        documents = parsed.select("doc_id", "url", "service_name", "title", "content_hash", "crawled_at", now.alias("updated_at"))
        chunks = exploded(parsed, "doc_id", "url").withColumn("chunk_id", index.chunk_id()).withColumnRenamed("doc_id", "document_id").drop("url", "title")
        crawled = parsed.select("url", "content_hash", "crawled_at")
        return index.upsert(store, documents, embed(chunks, factory=factory or functools.partial(HashingEmbedder, settings.vector_dim)), crawled.withColumnRenamed("crawled_at", "last_crawled_at"))
    finally:
        parsed.unpersist()


def stream_pages(pages: DataFrame, store: index.VersionedStore, checkpoint: str):
    """Starts the ingest of a stream of pages. A batch that comes again after a failure changes nothing: its hashes are known."""
    return pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest_batch(store, batch)).start()


def stream_rate_limit(log: DataFrame, key: str, at: str, order: str, rate: float = RATE, burst: int = BURST, idle: float = IDLE) -> DataFrame:
    """(key, order, ts, allowed) of a stream of requests; a key unseen for ``idle`` seconds of the stream's own time is forgotten."""
    picked = log.select(key, order, at).withWatermark(at, f"{int(idle)} seconds")
    out = picked.withColumn("allowed", F.lit(True)).schema

    def run(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values([at, order], kind="stable")
        times = rows[at].to_numpy().astype("datetime64[us]").astype(np.int64) / 1e6
        tokens, last = state.get if state.exists else (float(burst), times[0])
        allowed, tokens, last = token_bucket(times, rate, burst, tokens, last)
        state.update((float(tokens), float(last)))
        state.setTimeoutTimestamp(max(int((last + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows.assign(allowed=allowed)

    return picked.groupBy(key).applyInPandasWithState(run, out, "tokens double, last double", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(log: DataFrame, at: str, kind: str, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, window_end, kind, n) with a watermark; the same plan serves batch and stream."""
    w = F.window(at, size, slide or size)
    return log.withWatermark(at, late).groupBy(w.alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")
