"""Batched hybrid search: requests in, ranked and enriched chunks out."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.operators import fusion, keyword, vector
from fathom.session import exact_unions, materialize

OVER_FETCH = 3


@dataclass
class Arms:
    """What the arms gave: rows where they ran, the error where they failed."""

    vector: DataFrame | None = None
    keyword: DataFrame | None = None
    vector_error: Exception | None = None
    keyword_error: Exception | None = None


def filtered(chunks: DataFrame, documents: DataFrame, services: list[str] | None) -> DataFrame:
    """Chunks of documents of the services; no services means all. The filter reaches the scan of the documents."""
    if not services:
        return chunks
    wanted = documents.where(F.col("service_name").isin(services)).select(F.col("doc_id").alias("document_id"))
    return chunks.join(wanted, "document_id", "left_semi")


def keyword_arm(requests: DataFrame, chunks: DataFrame, k: int, index: keyword.KeywordIndex | None = None, subset: bool = False) -> DataFrame:
    """The k best chunks of each request by keywords. With an index only the postings of asked terms are read; ``subset``
    says that the chunks are fewer than those indexed."""
    # written, so that the join with the postings knows how small the terms are
    terms = materialize(keyword.query_terms(requests), "terms")
    if index is None:
        posted = keyword.postings(chunks)
    else:
        posted = index.of(terms)
        if subset:
            posted = posted.join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return keyword.top_k(keyword.cover_density(keyword.hits(posted, terms)), k)


def vector_arm(requests: DataFrame, chunks: DataFrame, k: int, dim: int) -> DataFrame:
    corpus = chunks.select("chunk_id", F.col("embedding").alias("vector"))
    return vector.top_k_batch(requests, corpus, k, dim, id_col="chunk_id").withColumnRenamed("id", "chunk_id")


def run_arms(requests: DataFrame, chunks: DataFrame, top_k: int, dim: int, index: keyword.KeywordIndex | None = None) -> Arms:
    """Each arm by itself and to its end, both at the same time, so that an arm that cannot be planned or whose job fails leaves the other alone.

    What is written are the over-fetched ranks of each request. Requests without vector take part in the keyword arm only.
    """

    def attempt(make: Callable[[], DataFrame], label: str) -> tuple[DataFrame | None, Exception | None]:
        try:
            return materialize(make(), label), None
        except Exception as e:  # noqa: BLE001
            return None, e

    with ThreadPoolExecutor(2) as pool:
        by_vector = pool.submit(attempt, lambda: vector_arm(requests.where("vector IS NOT NULL"), chunks, OVER_FETCH * top_k, dim), "vector-arm")
        by_keyword = pool.submit(attempt, lambda: keyword_arm(requests, chunks, OVER_FETCH * top_k, index), "keyword-arm")
        (vectors, vector_error), (keywords, keyword_error) = by_vector.result(), by_keyword.result()
    if vectors is None and keywords is None:
        raise RuntimeError(f"both arms failed: {vector_error}; {keyword_error}")
    return Arms(vectors, keywords, vector_error, keyword_error)


def hybrid(requests: DataFrame, chunks: DataFrame, top_k: int, dim: int = 64, index: keyword.KeywordIndex | None = None) -> DataFrame:
    """(query_id, chunk_id, score, vector_rank, keyword_rank, rank, score_kind) for requests (query_id, query, vector).

    Requests without vector (their embedding failed) are answered by keywords alone, with the keyword score. The
    keyword arm runs once for both.
    """
    arms = run_arms(requests, chunks, top_k, dim, index)
    plain = requests.where("vector IS NULL").select("query_id")
    if arms.keyword is None:
        if plain.take(1):
            raise RuntimeError(f"requests without vector have no other arm: {arms.keyword_error}")
        return fusion.rrf(arms.vector, arms.vector.limit(0), top_k).withColumn("score_kind", F.lit("rrf"))
    exact_unions(requests.sparkSession)
    both = arms.keyword.join(plain, "query_id", "left_anti")
    fused = fusion.rrf(arms.vector if arms.vector is not None else arms.keyword.limit(0), both, top_k).withColumn("score_kind", F.lit("rrf"))
    return fused.unionByName(_by_keyword(arms.keyword.join(plain, "query_id", "left_semi"), top_k))


def _by_keyword(found: DataFrame, top_k: int) -> DataFrame:
    return found.where(F.col("rank") <= top_k).select("query_id", "chunk_id", "score", F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("keyword_rank"), "rank", F.lit("keyword").alias("score_kind"))


def fallback(requests: DataFrame, chunks: DataFrame, top_k: int, index: keyword.KeywordIndex | None = None) -> DataFrame:
    """The keyword arm alone: over-fetched, cut, with its own score."""
    return _by_keyword(keyword_arm(requests, chunks, OVER_FETCH * top_k, index), top_k)


def enrich(ranked: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Texts and documents of ranked chunks, fetched after the cut. Chunks without document are dropped.

    The cut is written first: its real size lets the scans of texts and documents be filtered without a shuffle.
    """
    ranked = materialize(ranked, "ranked")
    ids = ranked.select("chunk_id").distinct()
    texts = chunks.select("chunk_id", "document_id", "text", "chunk_type", "section_path", "token_count", "chunk_index").join(ids, "chunk_id", "left_semi")
    named = documents.select(F.col("doc_id").alias("document_id"), "url", "service_name", "title")
    return ranked.join(texts, "chunk_id").join(named, "document_id")


def missing_ranks(ranked: DataFrame) -> DataFrame:
    """Ranks of 0 where an arm did not find the chunk."""
    return ranked.fillna(0, ["vector_rank", "keyword_rank"])


def per_request_cut(ranked: DataFrame, requests: DataFrame) -> DataFrame:
    """Each request's own top_k (null: all)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return ranked.join(requests.select("query_id", "top_k"), "query_id").withColumn("rank", F.row_number().over(order)).where("top_k IS NULL OR rank <= top_k").drop("top_k")
