"""Queries of the ingest side: crawl, change detection, parsing, chunking, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.functions import text as X
from fathom.functions import urls as U
from fathom.operators import crawl, index
from fathom.operators.chunking import chunk_pages as chunk
from fathom.operators.chunking import exploded
from fathom.operators.chunking import run_statistics as statistics
from fathom.plans.common import Tables, query
from fathom.sources import tables
from fathom.sources.html import flatten_html, outline

#: Fixed values of the SQL below: tokens as the token expression counts them.
_TOKEN_SQL = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x0B\x1C-\x1F\x{85}]"
_SKIP_SQL = r"(?i)/pricing/|/api[_-]?ref|/APIReference/|/release-?notes/|\.pdf$|\.zip$|#"
_HREF_SQL = r'(?i)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)"'
_NORMAL_SQL = "CASE WHEN ends_with({b}, '/') AND length({b}) - length(replace({b}, '/', '')) > 3 THEN regexp_replace({b}, '/+$', '') ELSE {b} END"


def _normal(url: str) -> str:
    return _NORMAL_SQL.format(b=f"regexp_replace({url}, '#.*$', '', 's')")


@query("SELECT crawl_id, sha256(html) AS sha, sha256(html) = content_hash AS same FROM crawl_result WHERE html IS NOT NULL")
def content_hash(spark, sf_dir):
    sha = F.sha2("html", 256)
    return Tables(spark, sf_dir).crawl_result.where("html IS NOT NULL").select("crawl_id", sha.alias("sha"), (sha == F.col("content_hash")).alias("same"))


_KNOWN_SQL = "known AS (SELECT url, content_hash FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY last_crawled_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS r FROM crawl_state WHERE url IS NOT NULL) WHERE r = 1)"


@query(f"WITH {_KNOWN_SQL} SELECT crawl_id FROM crawl_result p WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.url = p.url AND k.content_hash = p.content_hash)")
def change_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return index.changed(t.crawl_result.select("crawl_id", "url", "content_hash"), t.crawl_state).select("crawl_id")


@query("""
    WITH b AS (SELECT url, content_hash, last_crawled_at, 0 AS n FROM crawl_state UNION ALL SELECT url, content_hash, crawled_at, 1 FROM crawl_result),
    r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY n DESC, last_crawled_at DESC NULLS LAST, content_hash DESC NULLS LAST) AS r FROM b WHERE url IS NOT NULL)
    SELECT url, content_hash, epoch_us(last_crawled_at) AS last_crawled_us FROM r WHERE r = 1
""")
def crawl_state_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    merged = index.merge_state(t.crawl_state, t.crawl_result)
    return merged.select("url", "content_hash", F.unix_micros("last_crawled_at").alias("last_crawled_us"))


@query("""
    WITH n AS (SELECT url, content_hash, service_name, row_number() OVER (PARTITION BY url ORDER BY crawled_at DESC NULLS LAST, content_hash DESC NULLS LAST, crawl_id DESC) AS r FROM crawl_result WHERE url IS NOT NULL),
    fresh AS (SELECT url, content_hash, service_name FROM n WHERE r = 1)
    SELECT url, content_hash, service_name, 'kept' AS origin FROM documents WHERE url NOT IN (SELECT url FROM fresh)
    UNION ALL SELECT url, content_hash, service_name, 'new' FROM fresh
""")
def upsert_documents(spark, sf_dir):
    t = Tables(spark, sf_dir)
    fresh = index.newest(t.crawl_result.where("url IS NOT NULL").select("url", "crawled_at", "content_hash", "crawl_id", "service_name"), "url", "crawled_at", "content_hash", "crawl_id")
    fresh = fresh.select("url", "content_hash", "service_name", F.lit("new").alias("origin"))
    old = t.documents.select("url", "content_hash", "service_name", F.lit("kept").alias("origin"))
    return index.replace_rows(old, fresh, "url")


@query("""
    SELECT c.crawl_id, CASE WHEN d.content_hash IS NULL THEN 'new' WHEN d.content_hash = c.content_hash THEN 'same' ELSE 'changed' END AS state
    FROM crawl_result c LEFT JOIN documents d ON d.url = c.url
""")
def skip_same_hash(spark, sf_dir):
    t = Tables(spark, sf_dir)
    known = t.documents.select("url", F.col("content_hash").alias("known"))
    state = F.when(F.col("known").isNull(), "new").when(F.col("known") == F.col("content_hash"), "same").otherwise("changed")
    return t.crawl_result.join(known, "url", "left").select("crawl_id", state.alias("state"))


@query(f"SELECT DISTINCT href, {_normal('href')} AS url FROM page_link WHERE href IS NOT NULL")
def url_normalize(spark, sf_dir):
    return Tables(spark, sf_dir).page_link.where("href IS NOT NULL").select("href").distinct().withColumn("url", U.normalize(F.col("href")))


@query(f"SELECT crawl_id, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS place FROM (SELECT crawl_id, regexp_extract_all(html, '{_HREF_SQL}', 1) AS h FROM crawl_result WHERE html IS NOT NULL)")
def link_extract(spark, sf_dir):
    return Tables(spark, sf_dir).crawl_result.where("html IS NOT NULL").select("crawl_id", F.posexplode(U.hrefs(F.col("html"))).alias("place", "href")).withColumn("place", F.col("place").cast("long"))


@query("""
    WITH s AS (SELECT url, regexp_extract(url, '^([^?#]*)', 1) AS b FROM documents),
    p AS (SELECT url, regexp_extract(b, '^([a-zA-Z][\\w+.-]*://[^/]*)', 1) AS root, b FROM s),
    q AS (SELECT url, root, substring(b, length(root) + 1) AS path FROM p),
    c AS (SELECT url, root || CASE WHEN regexp_matches(path, '[^/]*\\.[^/]*$') THEN regexp_replace(path, '/[^/]*$', '') ELSE path END AS d FROM q)
    SELECT url, CASE WHEN ends_with(d, '/') AND length(d) - length(replace(d, '/', '')) > 3 THEN regexp_replace(d, '/+$', '') ELSE d END AS prefix FROM c
""")
def seed_scope(spark, sf_dir):
    return Tables(spark, sf_dir).documents.select("url", U.scope_prefix(F.col("url")).alias("prefix"))


PREFIXES = ["https://queuely.docs.nimbra.example/latest", "https://netweave.docs.nimbra.example/dev", "https://keyward.docs.nimbra.example/faq/a"]


@query(f"SELECT doc_id, url FROM documents WHERE {' OR '.join(f"starts_with(url, '{p}')" for p in PREFIXES)}")
def scope_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    prefixes = spark.createDataFrame([(p,) for p in PREFIXES], "prefix string")
    return crawl.in_scope(t.documents.select("doc_id", "url"), prefixes, "url")


@query(f"SELECT DISTINCT href FROM page_link WHERE href IS NOT NULL AND NOT regexp_matches(href, '{_SKIP_SQL}')")
def skip_filter(spark, sf_dir):
    return Tables(spark, sf_dir).page_link.where(F.col("href").isNotNull() & ~U.skipped(F.col("href"))).select("href").distinct()


@query("""
    WITH n AS (SELECT doc_id, url, lower(regexp_extract(url, '(?i)^https?://([\\w-]+)\\.docs\\.', 1)) AS name FROM documents)
    SELECT doc_id, CASE name WHEN '' THEN 'unknown' WHEN 'objectvault' THEN 's3' WHEN 'queuely' THEN 'sqs' ELSE name END AS service FROM n
""")
def service_name(spark, sf_dir):
    named = U.service_of(F.col("url"), U.HOST_SERVICE_PATTERN, {"objectvault": "s3", "queuely": "sqs"})
    return Tables(spark, sf_dir).documents.select("doc_id", named.alias("service"))


def _absolute_links(t: Tables):
    """Links between pages that are written as whole urls."""
    whole = t.page_link.where(F.col("href").startswith("http") & F.col("page_url").isNotNull()).select("page_url", "href").distinct()
    return whole.select(U.normalize(F.col("page_url")).alias("src"), U.normalize(F.col("href")).alias("dst")).distinct()


@query(f"""
    WITH RECURSIVE links AS (
        SELECT DISTINCT {_normal('page_url')} AS src, {_normal('href')} AS dst FROM page_link WHERE href LIKE 'http%' AND page_url IS NOT NULL
    ), edges AS (SELECT src, dst FROM links WHERE NOT regexp_matches(dst, '{_SKIP_SQL}')),
    seeds AS (SELECT min(src) AS url FROM links),
    r AS (SELECT url FROM seeds UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.url)
    SELECT url FROM r
""")
def bfs_reachable(spark, sf_dir):
    links = _absolute_links(Tables(spark, sf_dir))
    return crawl.reachable(links.agg(F.min("src").alias("url")), links).select("url")


@query()
def crawl_in_scope(spark, sf_dir):
    """The whole table's crawl: every service's documents are seeds, all anchors are resolved against their pages; it stays below the seeds' directories."""
    t = Tables(spark, sf_dir)
    links = crawl.resolved_links(t.page_link)
    seeds = t.documents.where("url IS NOT NULL").select("url").distinct()
    prefixes = seeds.select(U.scope_prefix(F.col("url")).alias("prefix")).distinct()
    return crawl.reachable(seeds, links, prefixes)


@query("""
    WITH a AS (SELECT url, row_number() OVER (ORDER BY doc_id) AS position FROM documents), b AS (SELECT url, row_number() OVER (ORDER BY crawl_id) AS position FROM crawl_result),
    u AS (SELECT url, 0 AS side, position FROM a UNION ALL SELECT url, 1, position FROM b),
    f AS (SELECT url, min((side, position)) AS p FROM u WHERE url IS NOT NULL GROUP BY 1)
    SELECT url, CAST(row_number() OVER (ORDER BY p) AS INTEGER) AS position FROM f
""")
def seed_merge(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return index.merge_unique(*(index.numbered(df.select("url", by), by) for df, by in ((t.documents, "doc_id"), (t.crawl_result, "crawl_id"))))


@query("SELECT * FROM (VALUES ('s3', 'https://docs.aws.amazon.com/AmazonS3/latest/userguide/', 0), ('iam', 'https://docs.aws.amazon.com/IAM/latest/UserGuide/', 1)) v(service, url, position)")
def seed_resolve(spark, sf_dir):
    return tables.seeds(spark, ["S3", "iam", "no such service"])


@query("SELECT crawl_id, url FROM crawl_result ORDER BY crawl_id LIMIT 100")
def page_limit(spark, sf_dir):
    return tables.first_pages(Tables(spark, sf_dir).crawl_result, 100, "crawl_id").select("crawl_id", "url")


@query("""
    WITH t AS (SELECT crawl_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS full_title FROM crawl_result WHERE html IS NOT NULL)
    SELECT crawl_id, trim(CASE WHEN contains(full_title, ' - Nimbra') THEN split_part(full_title, ' - Nimbra', 1) ELSE full_title END) AS title FROM t
""")
def page_title(spark, sf_dir):
    full = F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    return Tables(spark, sf_dir).crawl_result.where("html IS NOT NULL").select("crawl_id", F.trim(F.substring_index(full, " - Nimbra", 1)).alias("title"))


@query(r"""
    WITH t AS (SELECT crawl_id, html, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)(?:</title|$)', 1)) AS title FROM crawl_result),
    h AS (SELECT crawl_id, title, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1', 1) AS h1 FROM t)
    SELECT crawl_id, CASE WHEN coalesce(title, '') <> '' THEN title ELSE trim(regexp_replace(regexp_replace(coalesce(h1, ''), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) END AS title FROM h
""")
def parsed_title(spark, sf_dir):
    """Titles as the parser of pages gives them: of the head, else of the first heading."""
    return flatten_html(Tables(spark, sf_dir).spread("crawl_result").select("crawl_id", "html")).select("crawl_id", "title")


@query(f"SELECT chunk_id, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{_TOKEN_SQL}')) END::INTEGER AS tokens FROM chunks")
def token_count(spark, sf_dir):
    return Tables(spark, sf_dir).chunks.select("chunk_id", X.token_count(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)))::INTEGER AS sentences FROM documents WHERE text IS NOT NULL")
def sentence_split(spark, sf_dir):
    return Tables(spark, sf_dir).documents.where("text IS NOT NULL").select("doc_id", F.size(X.sentences(F.col("text"))).alias("sentences"))


@query(r"""
    SELECT chunk_id, regexp_matches(text, '(?i)"Effect"\s*:\s*"(Allow|Deny)"|"AWSTemplateFormatVersion"|"Resources"\s*:\s*\{|resource\s+"aws_|provider\s+"aws"|Type:\s+AWS::') AS config FROM chunks WHERE text IS NOT NULL
""")
def config_detect(spark, sf_dir):
    return Tables(spark, sf_dir).chunks.where("text IS NOT NULL").select("chunk_id", X.is_config(F.col("text")).alias("config"))


@query(r"""
    WITH p AS (SELECT chunk_id, document_id, chunk_index, chunk_type, section_path,
                      last_value(CASE WHEN chunk_type = 'prose' THEN chunk_id END IGNORE NULLS) OVER (PARTITION BY document_id, section_path ORDER BY chunk_index, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS context_id FROM chunks)
    SELECT chunk_id, context_id FROM p WHERE chunk_type IN ('code', 'config')
""")
def context_last_paragraph(spark, sf_dir):
    w = Window.partitionBy("document_id", "section_path").orderBy("chunk_index", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    c = Tables(spark, sf_dir).chunks.select("chunk_id", "document_id", "chunk_index", "chunk_type", "section_path")
    return c.withColumn("context_id", F.last(F.when(F.col("chunk_type") == "prose", F.col("chunk_id")), ignorenulls=True).over(w)).where("chunk_type IN ('code', 'config')").select("chunk_id", "context_id")


@query(rf"""
    WITH n AS (SELECT chunk_id, document_id, chunk_index, section_path, chunk_type, len(regexp_extract_all(text, '{_TOKEN_SQL}')) AS tokens FROM chunks WHERE text IS NOT NULL)
    SELECT chunk_id, CASE WHEN chunk_type = 'prose' AND lag(chunk_type) OVER w = 'prose' AND lag(section_path) OVER w = section_path THEN least(50, lag(tokens) OVER w) ELSE 0 END::INTEGER AS repeated
    FROM n WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id)
""")
def overlap_tail(spark, sf_dir):
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    c = Tables(spark, sf_dir).chunks.where("text IS NOT NULL")
    before = F.lag("text").over(w)
    follows = (F.col("chunk_type") == "prose") & (F.lag("chunk_type").over(w) == "prose") & (F.lag("section_path").over(w) == F.col("section_path"))
    return c.select("chunk_id", F.when(follows, X.token_count(X.tail_tokens(before, 50))).otherwise(0).alias("repeated"))


@query(rf"""
    WITH n AS (SELECT chunk_id, document_id, chunk_index, section_path, chunk_type, text FROM chunks WHERE text IS NOT NULL),
    p AS (SELECT chunk_id, CASE WHEN chunk_type = 'prose' AND lag(chunk_type) OVER w = 'prose' AND lag(section_path) OVER w = section_path THEN lag(text) OVER w END AS before FROM n WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id))
    SELECT chunk_id, CASE WHEN len(regexp_extract_all(before, '{_TOKEN_SQL}')) <= 50 THEN before ELSE regexp_extract(before, '(?s)(?:(?:{_TOKEN_SQL})[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]*){{50}}$') END AS repeated FROM p
""")
def overlap_text(spark, sf_dir):
    """The very text that an overlap of 50 tokens repeats of the chunk before."""
    w = Window.partitionBy("document_id").orderBy("chunk_index", "chunk_id")
    c = Tables(spark, sf_dir).chunks.where("text IS NOT NULL")
    follows = (F.col("chunk_type") == "prose") & (F.lag("chunk_type").over(w) == "prose") & (F.lag("section_path").over(w) == F.col("section_path"))
    return c.select("chunk_id", F.when(follows, X.tail_tokens(F.lag("text").over(w), 50)).alias("repeated"))


@query(rf"""
    WITH p AS (SELECT chunk_id, trim(text) AS whole, regexp_split_to_array(regexp_replace(trim(text), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM chunks WHERE text IS NOT NULL AND chunk_type = 'prose'),
    l AS (SELECT chunk_id, whole, s[len(s)] AS last FROM p)
    SELECT chunk_id, CASE WHEN len(regexp_extract_all(whole, '{_TOKEN_SQL}')) <= 100 THEN whole WHEN len(regexp_extract_all(last, '{_TOKEN_SQL}')) <= 100 THEN last
                          ELSE regexp_extract(last, '(?s)^(?:[\s\p{{Z}}\x0B\x1C-\x1F\x{{85}}]*(?:{_TOKEN_SQL})){{100}}') END AS context FROM l
""")
def context_text(spark, sf_dir):
    """What a code block would be told about each prose text, were it the paragraph before."""
    return Tables(spark, sf_dir).chunks.where("text IS NOT NULL AND chunk_type = 'prose'").select("chunk_id", X.context_line(F.col("text")).alias("context"))


@query(r"SELECT chunk_id, regexp_extract(text, '^(\[[\s\S]*?\] )', 1) AS header, substring(text, length(regexp_extract(text, '^(\[[\s\S]*?\] )', 1)) + 1) AS body FROM chunks WHERE text IS NOT NULL")
def header_split(spark, sf_dir):
    header, body = X.split_header(F.col("text"))
    return Tables(spark, sf_dir).chunks.where("text IS NOT NULL").select("chunk_id", header.alias("header"), body.alias("body"))


@query("SELECT document_id, list(chunk_id ORDER BY chunk_index, chunk_id) AS chunk_ids FROM chunks WHERE document_id IN (SELECT doc_id FROM documents) GROUP BY 1")
def group_chunks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    known = t.chunks.join(t.documents.select(F.col("doc_id").alias("document_id")), "document_id", "left_semi")
    return known.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x.chunk_id).alias("chunk_ids"))


@query()
def html_flatten(spark, sf_dir):
    flat = flatten_html(Tables(spark, sf_dir).spread("crawl_result").select("crawl_id", "html"))
    return flat.select("crawl_id", F.inline("nodes")).withColumn("headings", F.array_join(F.transform("headings", lambda h: h.text), " > "))


@query()
def page_outline(spark, sf_dir):
    flat = flatten_html(Tables(spark, sf_dir).spread("crawl_result").select("crawl_id", "html"))
    return flat.select("crawl_id", F.posexplode(outline(F.col("nodes"))).alias("line_no", "line"))


@query()
def chunk_pages(spark, sf_dir):
    return exploded(chunk(Tables(spark, sf_dir).spread("crawl_result").select("crawl_id", "html")), "crawl_id")


@query()
def run_statistics(spark, sf_dir):
    return statistics(chunk(Tables(spark, sf_dir).spread("crawl_result").select("crawl_id", "html")))


@query(f"""
    WITH u AS (SELECT doc_id, url, regexp_extract(url, '^[^?#]*', 0) AS bare FROM documents WHERE url IS NOT NULL),
    k AS (SELECT doc_id, bare, unnest(range(5)) AS kind FROM u WHERE regexp_matches(bare, '^[a-z]+://[^/]+/[^/]+/'))
    SELECT doc_id, CAST(kind AS INTEGER) AS kind, CASE WHEN kind = 4 THEN {_normal("bare || '?v=2'")} ELSE {_normal('bare')} END AS url FROM k
""")
def link_resolve(spark, sf_dir):
    """Links to each document's own page, written from its root, whole, beside it, from the folder above and as a query."""
    bare = F.regexp_extract("url", "^[^?#]*", 0)
    docs = Tables(spark, sf_dir).documents.where("url IS NOT NULL").select("doc_id", bare.alias("bare")).where(F.col("bare").rlike("^[a-z]+://[^/]+/[^/]+/"))
    path, last, two = (F.regexp_extract("bare", p, 1) for p in ("^[a-z]+://[^/]+(/.*)$", "([^/]*)$", "([^/]+/[^/]*)$"))
    written = F.array(path, F.concat("bare", F.lit("#part")), F.concat(F.lit("./"), last), F.concat(F.lit("../"), two), F.lit("?v=2"))
    links = docs.select("doc_id", "bare", F.posexplode(written).alias("kind", "href"))
    return links.select("doc_id", "kind", U.normalize(U.resolve("bare", "href")).alias("url"))
