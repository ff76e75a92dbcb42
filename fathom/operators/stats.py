"""Counts over the index and what the dashboard makes of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def totals(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return documents.agg(F.count("*").alias("documents")).crossJoin(chunks.agg(F.count("*").alias("chunks")))


def per_service(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(service_name, documents, chunks), services without chunks too. Chunks are counted per document before the join."""
    counts = chunks.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n"))
    return documents.select("doc_id", "service_name").join(counts, "doc_id", "left").groupBy("service_name").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def with_share(services: DataFrame) -> DataFrame:
    """Adds each service's share of all chunks, 0 if there are none, and its size against the largest."""
    whole = services.agg(F.sum("chunks").alias("_total"), F.max("chunks").alias("_most"))  # one row
    share = F.when(F.col("_total") > 0, F.col("chunks") / F.col("_total")).otherwise(0.0)
    return services.crossJoin(F.broadcast(whole)).withColumn("share", share).withColumn("bar", F.col("chunks") / F.greatest("_most", F.lit(1))).drop("_total", "_most")


def dashboard(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(documents, chunks, services, indexed_at, is_empty)"""
    one = documents.agg(F.count("*").alias("documents"), F.count_distinct("service_name").alias("services"), F.max("updated_at").alias("indexed_at"))
    return one.crossJoin(chunks.agg(F.count("*").alias("chunks"))).withColumn("is_empty", (F.col("documents") == 0) & (F.col("chunks") == 0) & (F.col("services") == 0))


def recall_at_k(neighbours: DataFrame, relevance: DataFrame) -> DataFrame:
    """(queries, hits, recall): a query hits if one of its neighbours (query_id, id) is relevant to it (query_id, id)."""
    asked = relevance.select("query_id").distinct()
    hit = neighbours.select("query_id", "id").join(relevance, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return asked.join(hit, "query_id", "left").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"), (F.count("hit") / F.count("*")).alias("recall"))
