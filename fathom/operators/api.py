"""The service's requests as a batch: a log of requests in, their responses out.

Routes: ``GET /healthz`` and ``/readyz``, ``POST /api/v1/search``, ``GET /api/v1/stats``; the last two are rate limited
by client. What a request is refused for, and with which status, is decided before anything is searched.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathom.functions import presentation as P
from fathom.operators import answer, keyword, search, serving, stats
from fathom.operators.embed import HashingEmbedder, embed
from fathom.session import exact_unions, materialize

BODY = "struct<query:string,top_k:int,services:array<string>,stream:boolean,_bad:string>"
LIMITED = ("/api/v1/search", "/api/v1/stats")
METHODS = {"/healthz": "GET", "/readyz": "GET", "/api/v1/search": "POST", "/api/v1/stats": "GET"}


def _error(text: Column) -> Column:
    return F.to_json(F.struct(text.alias("error")))


def routed(requests: DataFrame, ready: Mapping[str, str], rate: float | None = None, burst: int | None = None) -> DataFrame:
    """Requests (request_id, client, ts, method, path, body) with (status, response, query, top_k, services, stream).

    Status and response are null for those that are to be answered by a search or by statistics.
    """
    limited = requests.where(F.col("path").isin(*LIMITED))
    passed = serving.rate_limit(limited, "client", "ts", "request_id", rate, burst).select("request_id", "allowed")
    parsed = F.from_json("body", BODY, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = requests.join(passed, "request_id", "left").withColumn("_b", parsed)
    method = F.coalesce(*(F.when(F.col("path") == p, F.lit(m)) for p, m in METHODS.items()))
    searching = F.col("path") == "/api/v1/search"
    bad = searching & (F.col("body").isNull() | F.col("_b._bad").isNotNull() | F.col("_b").isNull())
    wrong = P.validate(F.col("_b.query"), F.col("_b.top_k"))
    well = all(v == "ok" for v in ready.values())
    rules = (
        (method.isNull(), 404, _error(F.lit("not found"))),
        (F.col("method") != method, 405, _error(F.lit("method not allowed"))),
        (F.col("path") == "/healthz", 200, F.lit(json.dumps({"status": "ok"}, separators=(",", ":")))),
        (F.col("path") == "/readyz", 200 if well else 503, F.lit(json.dumps(dict(ready), separators=(",", ":")))),
        (~F.col("allowed"), 429, _error(F.lit("rate limit exceeded"))),
        (bad, 400, _error(F.lit("invalid request body"))),
        (searching & wrong.isNotNull(), 400, _error(wrong)),
    )
    status, response = F.lit(None).cast("int"), F.lit(None).cast("string")
    for when, code, text in reversed(rules):
        status, response = F.when(when, code).otherwise(status), F.when(when, text).otherwise(response)
    top_k = F.coalesce("_b.top_k", F.lit(P.TOP_K_DEFAULT))
    services = F.array_sort(F.array_distinct(F.coalesce("_b.services", F.array().cast("array<string>"))))
    return rows.select("request_id", "path", status.alias("status"), response.alias("response"), F.col("_b.query").alias("query"), top_k.alias("top_k"), services.alias("services"), F.coalesce("_b.stream", F.lit(False)).alias("stream"))


def _stats_body(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(response): one row."""
    per = stats.per_service(documents, chunks)
    services = per.agg(F.array_sort(F.collect_list(F.struct("service_name", "documents", "chunks"))).alias("services"))  # one entry a service
    whole = stats.dashboard(documents, chunks)
    body = F.to_json(F.struct(F.col("documents").alias("total_documents"), F.col("chunks").alias("total_chunks"), "services", "indexed_at"))
    return whole.drop("services").crossJoin(services).select(body.alias("response"))


def _search_bodies(asked: DataFrame, chunks: DataFrame, documents: DataFrame, dim: int, factory, provider, index: keyword.KeywordIndex | None) -> DataFrame:
    """(request_id, status, response, content_type) of valid searches. Requests of the same services are searched as one batch."""
    embedded = materialize(embed(asked, "query", "vector", factory, query=True).withColumnRenamed("request_id", "query_id"), "asked")
    found: DataFrame | None = None
    for (services,) in embedded.select("services").distinct().collect():  # a plan for each set of services that is asked for
        mine = embedded.where(F.col("services") == (F.array(*map(F.lit, services)) if services else F.array().cast("array<string>")))
        part = search.hybrid(mine, search.filtered(chunks, documents, services), P.TOP_K_MAX, dim, None if services else index)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return asked.select("request_id", F.lit(200).alias("status"), F.lit("").alias("response"), F.lit("").alias("content_type")).limit(0)
    found = materialize(search.enrich(search.per_request_cut(found, embedded), chunks, documents), "found")
    answered = answer.answer(answer.prompts(found, embedded), provider).select("query_id", "answer", "ok")
    any_found = found.groupBy("query_id").agg(F.count("*").cast("int").alias("chunks_found"))
    answered = materialize(embedded.select("query_id", "stream").join(any_found, "query_id", "left").join(answered, "query_id"), "answered")
    empty = F.col("chunks_found").isNull()
    answered = answered.withColumn("answer", F.when(empty, answer.NOTHING_FOUND).otherwise(F.col("answer"))).withColumn("ok", F.col("ok") | empty)
    cited = answer.citations(answered.where("ok").select("query_id", "answer"), found)
    cite = F.struct("cite_no", F.struct("chunk_id", F.col("url").alias("document_url"), "title", "service_name", "section_path", "text", "score").alias("c"))
    lists = cited.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(cite)), lambda x: x.c).alias("citations"))
    kind = lists.schema["citations"].dataType
    told = answered.join(lists, "query_id", "left").withColumn("citations", F.coalesce("citations", F.array().cast(kind)))
    metadata = F.struct(F.coalesce("chunks_found", F.lit(0)).alias("chunks_found"), F.lit(False).alias("cache_hit"), F.lit(getattr(provider, "model", "unknown")).alias("model"))
    whole = F.to_json(F.struct("answer", "citations", metadata.alias("metadata")))
    events = F.concat(P.sse_event(F.lit("chunk"), F.col("answer")), P.sse_event(F.lit("citations"), F.to_json("citations")), P.sse_event(F.lit("metadata"), F.to_json(metadata)), P.sse_event(F.lit("done"), F.lit(None).cast("string")))
    failed = F.when(F.col("stream"), P.sse_event(F.lit("error"), F.lit("generation failed"))).otherwise(_error(F.lit("generation failed")))
    return told.select(
        F.col("query_id").alias("request_id"),
        F.when(F.col("ok") | F.col("stream"), 200).otherwise(500).alias("status"),
        F.when(~F.col("ok"), failed).when(F.col("stream"), events).otherwise(whole).alias("response"),
        F.when(F.col("stream"), "text/event-stream").otherwise("application/json").alias("content_type"),
    )


def responses(
    requests: DataFrame, chunks: DataFrame, documents: DataFrame, dim: int = 64, factory=HashingEmbedder, provider=answer.ExtractiveProvider, index: keyword.KeywordIndex | None = None, ready: Mapping[str, str] | None = None, rate: float | None = None, burst: int | None = None
) -> DataFrame:
    """(request_id, status, response, content_type) for each request (request_id, client, ts, method, path, body)."""
    exact_unions(requests.sparkSession)
    rows = materialize(routed(requests, ready or {"index": "ok", "embedder": "ok"}, rate, burst), "routed")
    json_type = F.lit("application/json").alias("content_type")
    done = rows.where("status IS NOT NULL").select("request_id", "status", "response", json_type)
    counted = rows.where("status IS NULL AND path = '/api/v1/stats'").select("request_id", F.lit(200).alias("status"))
    counted = counted.crossJoin(F.broadcast(_stats_body(documents, chunks))).select("request_id", "status", "response", json_type)
    asked = rows.where("status IS NULL AND path = '/api/v1/search'").select("request_id", "query", "top_k", "services", "stream")
    return done.unionByName(counted).unionByName(_search_bodies(asked, chunks, documents, dim, factory, provider, index))


def proxied(upstream: DataFrame) -> DataFrame:
    """What a proxy passes on of (request_id, status, response, content_type): other than 2xx, and null for unreachable, become 502 with the text as error."""
    well = F.col("status").between(200, 299)
    text = F.coalesce(F.when(F.col("response") != "", F.col("response")), F.concat(F.lit("Upstream returned "), F.col("status").cast("string")), F.lit("Upstream request failed"))
    return upstream.select("request_id", F.when(well, F.col("status")).otherwise(502).alias("status"), F.when(well, F.col("response")).otherwise(_error(text)).alias("response"), F.when(well, F.col("content_type")).otherwise("application/json").alias("content_type"))
