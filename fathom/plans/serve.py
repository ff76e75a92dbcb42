"""Queries of the serving side: answers, requests, caches, limits, statistics, presentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathom.functions import presentation as P
from fathom.functions import text as X
from fathom.operators import answer, api, search, serving, stats
from fathom.plans.common import Tables, embedded_requests, query, r6, requests, stored_postings
from fathom.streaming.ingest import windowed_counts


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks")
def stats_global(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.totals(t.documents, t.chunks)


_PER_SERVICE_SQL = "p AS (SELECT d.service_name, count(DISTINCT d.doc_id) AS documents, count(c.chunk_id) AS chunks FROM documents d LEFT JOIN chunks c ON c.document_id = d.doc_id GROUP BY 1)"


@query(f"WITH {_PER_SERVICE_SQL} SELECT * FROM p")
def stats_per_service(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.per_service(t.documents, t.chunks)


@query(f"WITH {_PER_SERVICE_SQL} SELECT service_name, chunks, round(chunks / sum(chunks) OVER (), 6) AS share, round(chunks / greatest(max(chunks) OVER (), 1), 6) AS bar FROM p")
def stats_share(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.with_share(stats.per_service(t.documents, t.chunks)).select("service_name", "chunks", r6(F.col("share"), "share"), r6(F.col("bar"), "bar"))


@query(f"WITH {_PER_SERVICE_SQL} SELECT service_name, documents, chunks, CAST(row_number() OVER (ORDER BY chunks DESC, documents DESC, service_name NULLS LAST) AS INTEGER) AS place FROM p")
def stats_sorted(spark, sf_dir):
    from pyspark.sql.window import Window

    t = Tables(spark, sf_dir)
    order = Window.orderBy(F.desc("chunks"), F.desc("documents"), F.asc_nulls_last("service_name"))
    return stats.per_service(t.documents, t.chunks).withColumn("place", F.row_number().over(order))


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM chunks) AS chunks, (SELECT count(DISTINCT service_name) FROM documents) AS services, (SELECT epoch_us(max(updated_at)) FROM documents) AS indexed_us, false AS is_empty")
def dashboard_totals(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return stats.dashboard(t.documents, t.chunks).select("documents", "chunks", "services", F.unix_micros("indexed_at").alias("indexed_us"), "is_empty")


@query("SELECT DISTINCT service_name, CAST(list_reduce(list_prepend(0::HUGEINT, list_transform(string_split(service_name, ''), lambda c: ascii(c)::HUGEINT)), lambda h, c: (h * 31 + c) % 4294967296) % 10 AS BIGINT) AS color FROM documents WHERE service_name IS NOT NULL")
def service_color(spark, sf_dir):
    return Tables(spark, sf_dir).documents.where("service_name IS NOT NULL").select("service_name").distinct().withColumn("color", P.color_index(F.col("service_name")))


@query("SELECT event_id, CAST(least(4, floor(5 * least(1, greatest(0, value / 100)))) AS INTEGER) AS heat, printf('%.3f', round(value, 3)) AS score FROM events WHERE value IS NOT NULL")
def score_bucket(spark, sf_dir):
    return Tables(spark, sf_dir).events.where("value IS NOT NULL").select("event_id", P.heat(F.col("value") / 100).alias("heat"), P.three_decimals(F.round("value", 3)).alias("score"))


@query("""
    WITH d AS (SELECT doc_id, crawled_at, floor((epoch_us(TIMESTAMPTZ '2026-01-01 00:00:00+00') - epoch_us(crawled_at)) / 1e6 + 0.5) AS s FROM documents)
    SELECT doc_id, CASE WHEN crawled_at IS NULL THEN NULL ELSE CAST(floor(-s / CASE WHEN abs(s) < 60 THEN 1 WHEN abs(s) < 3600 THEN 60 WHEN abs(s) < 86400 THEN 3600 WHEN abs(s) < 2592000 THEN 86400 WHEN abs(s) < 31536000 THEN 2592000 ELSE 31536000 END + 0.5) AS BIGINT) END AS value,
           CASE WHEN crawled_at IS NULL THEN 'unknown' WHEN abs(s) < 60 THEN 'second' WHEN abs(s) < 3600 THEN 'minute' WHEN abs(s) < 86400 THEN 'hour' WHEN abs(s) < 2592000 THEN 'day' WHEN abs(s) < 31536000 THEN 'month' ELSE 'year' END AS unit
    FROM d
""")
def relative_time(spark, sf_dir):
    value, unit = P.relative_time(F.col("crawled_at"), F.lit("2026-01-01 00:00:00").cast("timestamp"))
    return Tables(spark, sf_dir).documents.select("doc_id", value.alias("value"), unit.alias("unit"))


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS preview FROM documents WHERE text IS NOT NULL")
def truncate_preview(spark, sf_dir):
    return Tables(spark, sf_dir).documents.where("text IS NOT NULL").select("doc_id", X.preview(F.col("text")).alias("preview"))


@query(r"SELECT chunk_id, regexp_split_to_array(section_path, '\s*>\s*') AS parts FROM chunks WHERE section_path IS NOT NULL")
def section_path_split(spark, sf_dir):
    return Tables(spark, sf_dir).chunks.where("section_path IS NOT NULL").select("chunk_id", X.path_parts(F.col("section_path")).alias("parts"))


@query("""
    WITH r AS (SELECT item_id, query, CASE WHEN item_id % 4 = 0 THEN NULL ELSE CAST(item_id AS INTEGER) END AS top_k FROM eval_item UNION ALL SELECT -1, '   ', 5 UNION ALL SELECT -2, NULL, 5)
    SELECT item_id, CASE WHEN query IS NULL OR trim(query) = '' THEN 'query is required' WHEN top_k IS NOT NULL AND NOT top_k BETWEEN 1 AND 20 THEN 'top_k must be between 1 and 20' END AS error, coalesce(top_k, 10) AS top_k FROM r
""")
def request_validate(spark, sf_dir):
    some = Tables(spark, sf_dir).eval_item.select("item_id", "query", F.when(F.col("item_id") % 4 == 0, F.lit(None)).otherwise(F.col("item_id")).cast("int").alias("top_k"))
    r = some.unionByName(spark.createDataFrame([(-1, "   ", 5), (-2, None, 5)], "item_id long, query string, top_k int"))
    return r.select("item_id", P.validate(F.col("query"), F.col("top_k")).alias("error"), F.coalesce("top_k", F.lit(P.TOP_K_DEFAULT)).alias("top_k"))


@query("SELECT item_id, least(20, greatest(1, CAST(item_id - 30 AS INTEGER))) AS top_k FROM eval_item")
def topk_clamp(spark, sf_dir):
    return Tables(spark, sf_dir).eval_item.select("item_id", P.clamp_top_k((F.col("item_id") - 30).cast("int")).alias("top_k"))


_SERVICES_SQL = "CASE WHEN len(s) > 0 THEN s END"


@query(f"WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(service_name, ' ') || ' , ' || lower(coalesce(lang, '')) || ',,', ','), lambda x: trim(x)), lambda x: x <> '') AS s FROM documents) SELECT doc_id, {_SERVICES_SQL} AS services FROM p")
def services_param_parse(spark, sf_dir):
    param = F.concat(F.coalesce("service_name", F.lit(" ")), F.lit(" , "), F.lower(F.coalesce("lang", F.lit(""))), F.lit(",,"))
    return Tables(spark, sf_dir).documents.select("doc_id", P.parse_services(param).alias("services"))


@query("SELECT doc_id, CASE WHEN service_name IN ('queuely', 'netweave') THEN list_filter(['queuely', 'netweave'], lambda x: x <> service_name) ELSE list_append(['queuely', 'netweave'], service_name) END AS services FROM documents WHERE service_name IS NOT NULL")
def service_filter_toggle(spark, sf_dir):
    held = F.array(F.lit("queuely"), F.lit("netweave"))
    return Tables(spark, sf_dir).documents.where("service_name IS NOT NULL").select("doc_id", P.toggle(held, F.col("service_name")).alias("services"))


@query("SELECT item_id, sha256(lower(query) || '|' || CAST(1 + item_id % 20 AS VARCHAR) || '|' || 'iam,s3') AS key FROM eval_item")
def cache_key(spark, sf_dir):
    return Tables(spark, sf_dir).eval_item.select("item_id", P.cache_key(F.col("query"), 1 + F.col("item_id") % 20, F.array(F.lit("s3"), F.lit("iam"))).alias("key"))


@query("""
    WITH RECURSIVE e AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    f AS (SELECT user_id, min(ts) AS fill FROM e GROUP BY 1
          UNION ALL SELECT f.user_id, (SELECT min(e.ts) FROM e WHERE e.user_id = f.user_id AND e.ts >= f.fill + INTERVAL 15 MINUTE) FROM f WHERE f.fill IS NOT NULL),
    fills AS (SELECT user_id, count(*) AS misses FROM f WHERE fill IS NOT NULL GROUP BY 1)
    SELECT e.user_id, count(*) - any_value(misses) AS hits, any_value(misses) AS misses FROM e JOIN fills USING (user_id) GROUP BY 1
""")
def cache_ttl_replay(spark, sf_dir):
    log = Tables(spark, sf_dir).events.where("ts IS NOT NULL AND user_id IS NOT NULL").select("user_id", "ts")
    replayed = serving.replay_cache(log, "user_id", "ts")
    return replayed.groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))


_REQUESTS_SQL = "e AS (SELECT event_id, user_id, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)"


@query(f"""
    WITH RECURSIVE {_REQUESTS_SQL},
    b AS (
        SELECT user_id, event_id, us, n, t AS last, 2.0::DOUBLE AS tokens, true AS allowed FROM e WHERE n = 1
        UNION ALL
        SELECT user_id, event_id, us, n, last, CASE WHEN tok >= 1 THEN tok - 1 ELSE tok END, tok >= 1
        FROM (SELECT e.user_id, e.event_id, e.us, e.n, greatest(b.last, e.t) AS last, least(3.0::DOUBLE, b.tokens + greatest(0.0::DOUBLE, e.t - b.last) * (1 / 3600)) AS tok FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
    )
    SELECT user_id, event_id, us AS ts_us, allowed FROM b
""")
def token_bucket(spark, sf_dir):
    log = Tables(spark, sf_dir).events.where("ts IS NOT NULL AND user_id IS NOT NULL")
    limited = serving.rate_limit(log, "user_id", "ts", "event_id", rate=1 / 3600, burst=3)
    return limited.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "allowed")


@query(f"""
    WITH RECURSIVE {_REQUESTS_SQL},
    b AS (
        SELECT user_id, event_id, us, n, t AS now, 2.0::DOUBLE AS tokens, 0.0::DOUBLE AS wait FROM e WHERE n = 1
        UNION ALL
        SELECT user_id, event_id, us, n, CASE WHEN tok < 1 THEN begun + (1 - tok) / (1 / 3600) ELSE begun END, CASE WHEN tok < 1 THEN 0.0::DOUBLE ELSE tok - 1 END, CASE WHEN tok < 1 THEN begun + (1 - tok) / (1 / 3600) ELSE begun END - t
        FROM (SELECT e.user_id, e.event_id, e.us, e.n, e.t, greatest(b.now, e.t) AS begun, least(3.0::DOUBLE, b.tokens + (greatest(b.now, e.t) - b.now) * (1 / 3600)) AS tok FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1)
    )
    SELECT user_id, event_id, us AS ts_us, round(wait, 3) AS wait FROM b
""")
def crawl_admission(spark, sf_dir):
    log = Tables(spark, sf_dir).events.where("ts IS NOT NULL AND user_id IS NOT NULL")
    admitted = serving.admission(log, "user_id", "ts", "event_id", rate=1 / 3600, burst=3)
    return admitted.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.round("wait", 3).alias("wait"))


@query("""
    WITH e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
    p AS (SELECT *, lag(n) OVER (PARTITION BY event_type, user_id ORDER BY n) AS prev FROM e),
    -- other keys asked for since the key's own last request: 20 of them push it out
    near AS (SELECT a.event_id, count(DISTINCT b.user_id) AS others FROM p a LEFT JOIN p b ON b.event_type = a.event_type AND b.n > a.prev AND b.n < a.n GROUP BY 1)
    SELECT event_type, e.event_id, prev IS NOT NULL AND others < 20 AS hit FROM p e JOIN near USING (event_id)
""")
def cache_lru_replay(spark, sf_dir):
    """One cache of 20 entries for each type of event, of an age that no entry reaches."""
    log = Tables(spark, sf_dir).events.where("ts IS NOT NULL AND user_id IS NOT NULL").select("event_type", "user_id", "ts", "event_id")
    return serving.replay_lru(log, "event_type", "user_id", "ts", "event_id", entries=20, ttl=1e9).select("event_type", "event_id", "hit")


@query("""
    WITH l AS (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY 1), e AS (SELECT max(last_seen) AS final FROM l)
    SELECT user_id, epoch_us(last_seen) AS last_us FROM l, e WHERE final - last_seen > INTERVAL 600 SECOND
""")
def idle_keys(spark, sf_dir):
    return serving.idle_keys(Tables(spark, sf_dir).events, "user_id", "ts").select("user_id", F.unix_micros(F.col("last_seen").cast("timestamp")).alias("last_us"))


@query("""
    SELECT trim(title) AS query, epoch_us(max(updated_at)) AS last_us FROM documents WHERE title IS NOT NULL AND trim(title) <> '' GROUP BY 1 ORDER BY max(updated_at) DESC, 1 LIMIT 8
""")
def recent_queries(spark, sf_dir):
    return serving.recent_queries(Tables(spark, sf_dir).documents, "title", "updated_at").select("query", F.unix_micros("last_used").alias("last_us"))


@query("""
    SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2
""")
def windowed_events(spark, sf_dir):
    log = Tables(spark, sf_dir).events.where("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    return windowed_counts(log, "ts", "event_type").select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


_CONTEXT_SQL = """
    ranked AS (SELECT c.document_id AS query_id, CAST(row_number() OVER (PARTITION BY c.document_id ORDER BY c.chunk_index, c.chunk_id) AS INTEGER) AS rank, c.chunk_id, c.text, c.section_path, d.url, d.title, d.service_name
               FROM chunks c JOIN documents d ON d.doc_id = c.document_id)"""


def _ranked(t: Tables):
    """Chunks of each document in order, as if they were what a question about it had found."""
    from pyspark.sql.window import Window

    named = t.documents.select(F.col("doc_id").alias("document_id"), "url", "title", "service_name")
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    return t.chunks.select("document_id", "chunk_id", "chunk_index", "text", "section_path").withColumn("rank", rank).join(named, "document_id").withColumnRenamed("document_id", "query_id").withColumn("score", F.round(1 / F.col("rank"), 6))


@query(f"""
    WITH {_CONTEXT_SQL}, b AS (
        SELECT query_id, rank, '### [' || rank || '] ' || coalesce(service_name, '') || ' — ' || coalesce(title, '') || chr(10) || CASE WHEN coalesce(section_path, '') <> '' THEN '**Section:** ' || section_path || chr(10) ELSE '' END
               || '**Source:** ' || coalesce(url, '') || chr(10) || chr(10) || coalesce(text, '') || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS block FROM ranked
    ), c AS (SELECT query_id, string_agg(block, '' ORDER BY rank) AS context FROM b GROUP BY 1)
    SELECT d.doc_id AS query_id, '## Retrieved Context' || chr(10) || chr(10) || coalesce(context, '') || '## Question' || chr(10) || chr(10) || coalesce(d.title, '') AS prompt
    FROM documents d LEFT JOIN c ON c.query_id = d.doc_id
""")
def prompt_build(spark, sf_dir):
    t = Tables(spark, sf_dir)
    asked = t.documents.select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("query"))
    return answer.prompts(_ranked(t), asked).select("query_id", F.col("user").alias("prompt"))


_ANSWER = "See [2] and [1]; also [2], [0], [99] and [3]. [note]"


@query(f"""
    WITH {_CONTEXT_SQL}, cited AS (SELECT * FROM (VALUES (2, 1), (1, 2), (3, 3)) v(ref_num, place))
    SELECT r.query_id, c.ref_num, CAST(row_number() OVER (PARTITION BY r.query_id ORDER BY place) AS INTEGER) AS cite_no, r.chunk_id, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS text
    FROM ranked r JOIN cited c ON c.ref_num = r.rank
""")
def citation_extract(spark, sf_dir):
    t = Tables(spark, sf_dir)
    answers = t.documents.select(F.col("doc_id").alias("query_id"), F.lit(_ANSWER).alias("answer"))
    return answer.citations(answers, _ranked(t)).select("query_id", "ref_num", "cite_no", "chunk_id", "text")


@query()
def answer_requests(spark, sf_dir):
    """Requests searched, prompted, answered by the extractive provider, and their citations."""
    t = Tables(spark, sf_dir)
    asked = embedded_requests(t)
    found = search.enrich(search.hybrid(asked, t.chunks, 5, index=stored_postings(t)), t.chunks, t.documents)
    answers = answer.answer(answer.prompts(found, asked))
    return answer.citations(answers.where("ok"), found)


@query()
def markdown_blocks(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(answer.markdown_blocks("text")).alias("place", "b")).select("doc_id", "place", "b.*")


@query(r"""
    SELECT chunk_id, list_transform(regexp_extract_all(regexp_replace(text, '`[^`]+`', ' ', 'g'), '\[([0-9]+)\]', 1), lambda x: TRY_CAST(x AS INTEGER)) AS marks FROM chunks WHERE text IS NOT NULL
""")
def inline_citations(spark, sf_dir):
    return Tables(spark, sf_dir).chunks.where("text IS NOT NULL").select("chunk_id", answer.inline_marks(F.col("text")).alias("marks"))


@query("SELECT doc_id, 'event: chunk' || chr(10) || 'data: ' || replace(text, chr(10), chr(10) || 'data: ') || chr(10) || chr(10) AS event FROM documents WHERE text IS NOT NULL")
def sse_encode(spark, sf_dir):
    return Tables(spark, sf_dir).documents.where("text IS NOT NULL").select("doc_id", P.sse_event(F.lit("chunk"), F.col("text")).alias("event"))


@query("SELECT doc_id, 'chunk' AS event, text AS data FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(13))")
def sse_decode(spark, sf_dir):
    """What an encoded stream holds is what was put in."""
    docs = Tables(spark, sf_dir).documents.where("text IS NOT NULL").where(~F.contains("text", F.lit("\r")))
    stream = F.concat(F.lit(": comment\n"), P.sse_event(F.lit("chunk"), F.col("text")), P.sse_event(F.lit("done"), F.lit(None).cast("string")))
    return docs.select("doc_id", F.inline(P.sse_parse(stream))).where("event = 'chunk'")


@query("SELECT doc_id, 'chunk' AS event, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS data FROM documents WHERE text IS NOT NULL")
def sse_decode_all(spark, sf_dir):
    """All documents through a stream. CR ends a line there, so every line end is put in as LF and comes out as LF."""
    docs = Tables(spark, sf_dir).documents.where("text IS NOT NULL")
    data = F.regexp_replace("text", "\r\n?", "\n")
    stream = F.concat(F.lit(": comment\n"), P.sse_event(F.lit("chunk"), data), P.sse_event(F.lit("done"), F.lit(None).cast("string")))
    return docs.select("doc_id", F.inline(P.sse_parse(stream))).where("event = 'chunk'")


@query("SELECT CAST(item_id AS BIGINT) + 1000 AS query_id, 'No matching documentation was found for this question.' AS answer FROM eval_item WHERE lower(query) NOT LIKE '% %' UNION ALL SELECT 4, 'No matching documentation was found for this question.'")
def empty_answer(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = requests(t).where(F.col("query_id") == 4)
    found = search.fallback(one, t.chunks, 10, stored_postings(t))
    return one.join(found, "query_id", "left_anti").select("query_id", F.lit(answer.NOTHING_FOUND).alias("answer"))


_CALLS_SQL = """
    calls AS (
        SELECT item_id AS request_id, item_id % 8 AS k, query FROM eval_item
    ), routed AS (
        SELECT request_id, k, CASE k WHEN 0 THEN 200 WHEN 1 THEN 200 WHEN 2 THEN 404 WHEN 3 THEN 405 WHEN 4 THEN 400 WHEN 5 THEN 400 WHEN 6 THEN 400 ELSE 200 END AS status,
               CASE k WHEN 2 THEN 'not found' WHEN 3 THEN 'method not allowed' WHEN 4 THEN 'invalid request body' WHEN 5 THEN 'top_k must be between 1 and 20' WHEN 6 THEN 'query is required' END AS error
        FROM calls
    )"""


@query(f"WITH {_CALLS_SQL} SELECT request_id, CAST(status AS INTEGER) AS status, error, k = 1 AS counted FROM routed")
def api_responses(spark, sf_dir):
    """A request of each kind: health, statistics, unknown path, wrong method, broken body, wrong fields, searches."""
    t = Tables(spark, sf_dir)
    k = F.col("item_id") % 8
    path = F.when(k == 0, "/healthz").when(k == 1, "/api/v1/stats").when(k == 2, "/nowhere").otherwise("/api/v1/search")
    method = F.when(k <= 3, "GET").otherwise("POST")
    body = F.when(k == 4, "{broken").when(k == 5, F.to_json(F.struct("query", F.lit(21).alias("top_k")))).when(k == 6, F.to_json(F.struct(F.lit("  ").alias("query")))).when(k == 7, F.to_json(F.struct("query", F.lit(3).alias("top_k"))))
    calls = t.eval_item.select(F.col("item_id").alias("request_id"), F.lit("c").alias("client"), F.timestamp_seconds("item_id").alias("ts"), method.alias("method"), path.alias("path"), body.alias("body"))
    got = api.responses(calls, t.chunks, t.documents, index=stored_postings(t))
    return got.select("request_id", "status", F.get_json_object("response", "$.error").alias("error"), F.get_json_object("response", "$.total_documents").isNotNull().alias("counted"))
