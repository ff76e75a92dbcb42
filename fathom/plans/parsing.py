"""Queries that build pages and streams of known content from the tables, and read them back with the parsers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.functions import presentation as P
from fathom.functions import wire
from fathom.operators import answer, index, search
from fathom.operators.chunking import chunk_pages, exploded, run_statistics
from fathom.operators.embed import embed
from fathom.plans.common import FIXED_SQL, VECTOR_ARM_SQL, Tables, embedded_requests, query, r6
from fathom.schemas import CHUNKS, CRAWL_STATE, DOCUMENTS
from fathom.session import shared_path
from fathom.sources import fetch, tables
from fathom.sources.html import flatten_html

_TOKEN_SQL = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


def _plain(text):
    """The words of a text in Latin letters and digits, one blank apart."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9]+", " "))


def built_pages(t: Tables) -> DataFrame:
    """(doc_id, html): a page of each document, with a section of its own for each of its chunks.

    Prose comes as paragraphs, notes and lists in turn; the markup leaves out end tags and stands between chrome.
    """
    kind, n = F.col("chunk_type"), F.col("n").cast("string")
    x = F.trim(F.concat(F.lit("Text "), _plain(F.col("text"))))
    paragraph = F.concat(F.lit("<p>"), x, F.lit("<p>More "), n)
    note = F.concat(F.lit('<div class="awsdocs-note"><p class="title">Warning</p><p>'), x, F.lit("</div>"))
    items = F.concat(F.lit("<ul><li>"), x, F.lit("<li>second</ul>"))
    code = F.concat(F.lit("<p>Intro "), n, F.lit('<pre class="programlisting"><code class="language-python">'), x, F.lit("</code></pre>"))
    config = F.concat(F.lit("<pre><code>Type: AWS::"), x, F.lit("</code></pre>"))
    table = F.concat(F.lit("<table><tr><th>k<th>v<tr><td>"), n, F.lit("<td>"), x, F.lit("</table>"))
    prose = F.when(F.col("n") % 3 == 1, paragraph).when(F.col("n") % 3 == 2, items).otherwise(note)
    body = F.when(kind == "code", code).when(kind == "config", config).when(kind == "table", table).otherwise(prose)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    parts = t.chunks.select("document_id", "chunk_type", "text", place.alias("n")).select(F.col("document_id").alias("doc_id"), "n", F.concat(F.lit("<h2>S"), n, F.lit("</h2>"), body).alias("part"))
    joined = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "part"))), lambda p: p.part), "\n").alias("body"))
    title = F.coalesce(F.nullif(_plain(F.col("title")), F.lit("")), F.lit("Untitled"))
    top, middle = F.lit("<html><head><title>"), F.lit(' - AWS Guide</title></head><body><nav><ul><li><a href="/">Home</a></ul></nav><div id="main-col-body"><div class="awsdocs-breadcrumb"><p>Here</div><h1>')
    page = F.concat(top, title, middle, title, F.lit("</h1>"), F.coalesce("body", F.lit("")), F.lit("<script>var a = '<p>no</p>';</script></div><footer><p>Foot</footer></body></html>"))
    return t.documents.select("doc_id", "title").join(joined, "doc_id", "left").select("doc_id", page.alias("html"))


_BUILT_SQL = """
    d AS (SELECT doc_id, coalesce(nullif(trim(regexp_replace(coalesce(title, ''), '[^A-Za-z0-9]+', ' ', 'g')), ''), 'Untitled') AS title FROM documents),
    c AS (SELECT document_id AS doc_id, chunk_type, trim('Text ' || trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g'))) AS x, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS n FROM chunks),
    s AS (
        SELECT doc_id, title, n, x, title || ' > S' || n AS path,
               CASE WHEN chunk_type IN ('code', 'config', 'table') THEN chunk_type WHEN n % 3 = 1 THEN 'paragraph' WHEN n % 3 = 2 THEN 'list' ELSE 'note' END AS kind
        FROM c JOIN d USING (doc_id)
    )"""


@query(f"""
    WITH {_BUILT_SQL},
    k AS (
        SELECT doc_id, n, 0 AS k, 'section' AS node_type, 'S' || n AS text, 2 AS level, NULL AS language, NULL AS note, path FROM s
        UNION ALL SELECT doc_id, n, 1, CASE WHEN kind = 'code' THEN 'paragraph' WHEN kind = 'config' THEN 'code' WHEN kind = 'note' THEN 'admonition' ELSE kind END,
                         CASE kind WHEN 'code' THEN 'Intro ' || n WHEN 'config' THEN 'Type: AWS::' || x WHEN 'table' THEN '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n || ' | ' || x || ' |' WHEN 'list' THEN '- ' || x || chr(10) || '- second' ELSE x END,
                         NULL, CASE WHEN kind = 'config' THEN 'yaml' END, CASE WHEN kind = 'note' THEN 'Warning' END, path FROM s
        UNION ALL SELECT doc_id, n, 2, CASE WHEN kind = 'code' THEN 'code' ELSE 'paragraph' END, CASE WHEN kind = 'code' THEN x ELSE 'More ' || n END, NULL, CASE WHEN kind = 'code' THEN 'python' END, NULL, path FROM s WHERE kind IN ('code', 'paragraph')
    )
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INTEGER) AS ord, CASE WHEN k = 0 THEN 1 ELSE 2 END AS depth, node_type, text, level, language, note, path FROM k
""")
def page_nodes(spark, sf_dir):
    """The content nodes of built pages: main part, titles, sections, paragraphs, notes, lists, tables, code and its language."""
    flat = flatten_html(built_pages(Tables(spark, sf_dir))).select("doc_id", F.inline("nodes"))
    return flat.select("doc_id", "ord", "depth", "node_type", "text", "level", "language", F.col("title").alias("note"), F.array_join(F.transform("headings", lambda h: h.text), " > ").alias("path"))


_CHUNKS_SQL = f"""
    w AS (SELECT *, '[' || path || '] ' AS head, string_split(x, ' ') AS words FROM s),
    k AS (
        SELECT doc_id, n, 0 AS k, path, CASE WHEN kind IN ('table', 'config') THEN kind ELSE 'prose' END AS chunk_type, CASE WHEN kind = 'config' THEN 'yaml' END AS language,
               CASE kind WHEN 'paragraph' THEN head || x WHEN 'note' THEN head || 'Warning: ' || x WHEN 'list' THEN head || '- ' || x || chr(10) || '- second' WHEN 'code' THEN head || 'Intro ' || n
                         WHEN 'config' THEN head || '```yaml' || chr(10) || 'Type: AWS::' || x || chr(10) || '```' ELSE head || '| k | v |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || n || ' | ' || x || ' |' END AS text FROM w
        UNION ALL SELECT doc_id, n, 1, path, CASE WHEN kind = 'code' THEN 'code' ELSE 'prose' END, CASE WHEN kind = 'code' THEN 'python' END,
               CASE kind WHEN 'code' THEN 'Context: Intro ' || n || chr(10) || head || '```python' || chr(10) || x || chr(10) || '```'
                         ELSE head || '...' || array_to_string(words[greatest(1, len(words) - 49) : len(words)], ' ') || '... More ' || n END FROM w WHERE kind IN ('code', 'paragraph')
    ),
    pieces AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1 AS INTEGER) AS chunk_index, text, chunk_type, path AS section_path, CAST(len(regexp_extract_all(text, '{_TOKEN_SQL}')) AS INTEGER) AS token_count, language FROM k)"""


@query(f"WITH {_BUILT_SQL}, {_CHUNKS_SQL} SELECT * FROM pieces")
def page_chunks(spark, sf_dir):
    """The chunks of built pages: headers, context of code, overlap of prose, types, token counts."""
    chunks = exploded(chunk_pages(built_pages(Tables(spark, sf_dir))), "doc_id")
    return chunks.select("doc_id", "chunk_index", "text", "chunk_type", "section_path", "token_count", F.nullif(F.try_element_at("metadata", F.lit("language")), F.lit("")).alias("language"))


@query(f"WITH {_BUILT_SQL}, {_CHUNKS_SQL}, has AS (SELECT count(DISTINCT doc_id) AS n, count(*) AS chunks FROM pieces) SELECT n AS crawled, (SELECT count(*) FROM documents) - n AS skipped, CAST(0 AS BIGINT) AS errored, chunks FROM has")
def page_statistics(spark, sf_dir):
    return run_statistics(chunk_pages(built_pages(Tables(spark, sf_dir))))


@query("SELECT doc_id, text AS choices, text AS blocks, text AS lines FROM documents WHERE text IS NOT NULL")
def wire_decode(spark, sf_dir):
    """Each text as a recorded stream of the three formats, in two parts, with noise before and after the stop."""
    docs = Tables(spark, sf_dir).documents.where("text IS NOT NULL")
    half = F.floor(F.length("text") / 2).cast("int")
    a, b = F.left(F.col("text"), half), F.substring(F.col("text"), half + 1, F.length("text"))
    choice = lambda c: F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(c.alias("content")).alias("delta"))).alias("choices"))), F.lit("\n\n"))
    block = lambda c: F.concat(F.lit("event: x\ndata: "), F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), c.alias("text")).alias("delta"))), F.lit("\n\n"))
    line = lambda c, done: F.concat(F.to_json(F.struct(F.struct(c.alias("content")).alias("message"), F.lit(done).alias("done"))), F.lit("\n"))
    noise = F.lit("data: {broken\n\n")
    streams = docs.select(
        "doc_id",
        F.concat(choice(a), noise, choice(b), F.lit("data: [DONE]\n\n"), choice(a)).alias("c"),
        F.concat(block(a), noise, block(b), F.lit('data: {"type":"message_stop"}\n\n'), block(a)).alias("b"),
        F.concat(line(a, False), F.lit("{broken\n"), line(b, True), line(a, False)).alias("l"),
    )
    return streams.select("doc_id", wire.choices_text(F.col("c")).alias("choices"), wire.blocks_text(F.col("b")).alias("blocks"), wire.lines_text(F.col("l")).alias("lines"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) END AS answer FROM documents WHERE text IS NOT NULL")
def stream_answer(spark, sf_dir):
    """What the events of a stream spell out; every third stream ends in an error."""
    docs = Tables(spark, sf_dir).documents.where("text IS NOT NULL")
    text = F.regexp_replace("text", "\r\n?", "\n")
    last = F.when(F.col("doc_id") % 3 == 0, P.sse_event(F.lit("error"), F.lit("lost"))).otherwise(P.sse_event(F.lit("done"), F.lit(None).cast("string")))
    return docs.select("doc_id", wire.answer_of(P.sse_parse(F.concat(P.sse_event(F.lit("chunk"), text), last))).alias("answer"))


@query("SELECT DISTINCT trim(url) AS url FROM documents WHERE url IS NOT NULL")
def url_list(spark, sf_dir):
    """Urls of a list with comments, blank lines and indentation."""
    urls = Tables(spark, sf_dir).documents.where("url IS NOT NULL").select(F.concat(F.lit("  "), "url", F.lit("  \n# note\n\n")).alias("value"))
    path = shared_path(spark, "url-list")
    urls.write.text(path)
    return tables.url_list(spark, path).distinct()


@query("SELECT crawl_id FROM crawl_result WHERE crawl_id % 4 = 1")
def response_filter(spark, sf_dir):
    """Of answers of four kinds those that are pages."""
    k = F.col("crawl_id") % 4
    fetched = Tables(spark, sf_dir).crawl_result.select("crawl_id", F.when(k == 0, 404).otherwise(200).alias("status"), F.when(k == 1, "Text/HTML; charset=utf-8").when(k == 2, "application/pdf").when(k == 0, "text/html").alias("content_type"))
    return tables.html_responses(fetched).select("crawl_id")


class _Answers:
    """Answers by the end of the url, without a network."""

    def get(self, url: str) -> tuple[int, str, str]:
        kind = sum(map(ord, url)) % 4
        if kind == 0:
            raise TimeoutError(url)
        return (404, "text/html", "") if kind == 1 else (200, "text/html; charset=utf-8" if kind == 2 else "application/pdf", f"<p>{url}</p>")


@query("""
    WITH u AS (SELECT DISTINCT url, CAST(list_sum(list_transform(string_split(url, ''), lambda c: ord(c))) % 4 AS INTEGER) AS k FROM documents WHERE url IS NOT NULL)
    SELECT url, CASE k WHEN 1 THEN 404 WHEN 0 THEN NULL ELSE 200 END::INTEGER AS status, k = 0 AS failed, CASE WHEN k = 2 THEN sha256('<p>' || url || '</p>') END AS content_hash FROM u
""")
def fetch_pages(spark, sf_dir):
    """All urls fetched from a stand-in for the network: pages, other content, refusals and failures."""
    urls = Tables(spark, sf_dir).documents.select("url")
    got = fetch.fetch(urls, _Answers, rate=1e9)
    pages = fetch.fetch_pages(urls, _Answers, rate=1e9).select("url", "content_hash")
    return got.join(pages, "url", "left").select("url", "status", F.col("error").isNotNull().alias("failed"), "content_hash")


@query(r"SELECT chunk_id, CASE WHEN text IS NOT NULL THEN CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0 ELSE 0.0 END END::DOUBLE AS norm, CASE WHEN text IS NOT NULL THEN 64 END::INTEGER AS numbers FROM chunks")
def embed_norms(spark, sf_dir):
    """Vectors of texts with words are of unit length, of others zero, of null texts null."""
    out = embed(Tables(spark, sf_dir).spread("chunks").select("chunk_id", "text"))
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return out.select("chunk_id", F.round(F.sqrt(square), 4).alias("norm"), F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("numbers"))


@query("""
    WITH n AS (SELECT url, content_hash, service_name, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC NULLS LAST, content_hash DESC NULLS LAST, crawl_id DESC) AS r FROM crawl_result WHERE url IS NOT NULL),
    fresh AS (SELECT url, content_hash, service_name FROM n WHERE r = 1)
    SELECT url, content_hash, service_name FROM documents WHERE url NOT IN (SELECT url FROM fresh) UNION ALL SELECT url, content_hash, service_name FROM fresh
""")
def stored_upsert(spark, sf_dir):
    """The documents as a store holds them after an update by the newest fetch of each url."""
    t = Tables(spark, sf_dir)
    store = index.VersionedStore(spark, shared_path(spark, "store"), buckets=8)
    store.commit({"documents": t.documents.select("url", "content_hash", "service_name")})
    fresh = index.newest(t.crawl_result.where("url IS NOT NULL").select("url", "crawled_at", "content_hash", "crawl_id", "service_name"), "url", "crawled_at", "content_hash", "crawl_id").select("url", "content_hash", "service_name")
    store.update({"documents": (fresh, fresh)})
    return store.read("documents")


@query(f"WITH {FIXED_SQL}, {VECTOR_ARM_SQL} SELECT query_id, chunk_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, CAST(rank AS INTEGER) AS vector_rank, CAST(rank AS INTEGER) AS rank FROM ranked_vec WHERE rank <= 10")
def hybrid_one_arm(spark, sf_dir):
    """Hybrid search whose keyword arm fails, as the chunks have no text."""
    t = Tables(spark, sf_dir)
    found = search.hybrid(embedded_requests(t).where("vector IS NOT NULL"), t.chunks.drop("text"), 10)
    return found.select("query_id", "chunk_id", r6(F.col("score"), "score"), "vector_rank", "rank")


_COLUMNS = {"documents": DOCUMENTS, "chunks": CHUNKS, "crawl_state": CRAWL_STATE}


@query("""
    SELECT * FROM (VALUES
        ('documents', 'doc_id url service_name title content_hash crawled_at updated_at'),
        ('chunks', 'chunk_id document_id chunk_index text chunk_type section_path token_count metadata embedding'),
        ('crawl_state', 'url content_hash last_crawled_at')) v("table", columns)
""")
def store_schema(spark, sf_dir):
    """The columns of a new store's tables, as they are read back."""
    from fathom.schemas import initialize

    store = index.VersionedStore(spark, shared_path(spark, "store"))
    initialize(spark, store)
    return spark.createDataFrame([(name, " ".join(store.read(name).columns)) for name in _COLUMNS], "table string, columns string")


_X_SQL = "trim('Text ' || trim(regexp_replace(coalesce(text, ''), '[^A-Za-z0-9]+', ' ', 'g')))"


@query(f"""
    WITH x AS (SELECT chunk_id, {_X_SQL} AS x FROM chunks),
    b AS (
        SELECT chunk_id, 0 AS place, 'h' AS kind, 'Part ' || chunk_id AS text, NULL AS items, NULL AS lang, 2 AS level FROM x
        UNION ALL SELECT chunk_id, 1, 'p', x || chr(10) || 'more', NULL, NULL, NULL FROM x
        UNION ALL SELECT chunk_id, 2, 'ul', NULL, x || '|second', NULL, NULL FROM x
        UNION ALL SELECT chunk_id, 3, 'ol', NULL, 'first|' || x, NULL, NULL FROM x
        UNION ALL SELECT chunk_id, 4, 'code', x || chr(10) || chr(10) || '# no head', NULL, 'python', NULL FROM x
        UNION ALL SELECT chunk_id, 5, 'p', 'end', NULL, NULL, NULL FROM x
    )
    SELECT * FROM b
""")
def built_blocks(spark, sf_dir):
    """The blocks of answers built of known parts."""
    x = F.trim(F.concat(F.lit("Text "), _plain(F.col("text"))))
    source = F.concat(F.lit("## Part "), F.col("chunk_id").cast("string"), F.lit("\n"), x, F.lit("\nmore\n\n- "), x, F.lit("\n* second\n1. first\n2) "), x, F.lit("\n```python\n"), x, F.lit("\n\n# no head\n```\nend\n"))
    blocks = Tables(spark, sf_dir).spread("chunks").select("chunk_id", F.posexplode(answer.markdown_blocks(source)).alias("place", "b"))
    return blocks.select("chunk_id", "place", "b.kind", "b.text", F.array_join("b.items", "|").alias("items"), "b.lang", "b.level")


@query(f"""
    WITH c AS (SELECT document_id, {_X_SQL} AS x, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS n FROM chunks),
    a AS (SELECT document_id, string_agg(x || ' [' || n || ']', chr(10) ORDER BY n) AS answer FROM c WHERE n <= 3 GROUP BY 1)
    SELECT doc_id AS query_id, coalesce(answer, 'No matching documentation was found for this question.') AS answer, true AS ok FROM documents LEFT JOIN a ON document_id = doc_id
""")
def extractive_answers(spark, sf_dir):
    """Prompts of each document's chunks, answered by their leading sentences."""
    t = Tables(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id"))
    x = F.concat(F.lit("[Path] "), F.trim(F.concat(F.lit("Text "), _plain(F.col("text")))))
    named = t.documents.select(F.col("doc_id").alias("query_id"), "url", "title", "service_name")
    ranked = t.chunks.select(F.col("document_id").alias("query_id"), place.alias("rank"), x.alias("text"), "section_path").join(named, "query_id")
    asked = t.documents.select(F.col("doc_id").alias("query_id"), F.coalesce("title", F.lit("")).alias("query"))
    return answer.answer(answer.prompts(ranked, asked)).select("query_id", "answer", "ok")
