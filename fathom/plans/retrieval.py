"""Queries over the index: vectors, keywords, fusion, search."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.operators import ann, fusion, keyword, search, stats, vector
from fathom.operators.embed import embed

from fathom.plans.common import COVER_SQL, FIXED_SQL, HITS_SQL, HYBRID_SQL, POSTINGS_SQL, REQUESTS_SQL, TERMS_SQL, USABLE_SQL, VECTOR_ARM_SQL, Tables, embedded_requests, query, r6, requests, stored_postings
from fathom.session import materialize, shared_path

SERVICES = ["objectvault", "funcrunner", "queuely"]
_SERVICES_SQL = "('objectvault', 'funcrunner', 'queuely')"
_ONE = f"(SELECT embedding::DOUBLE[] FROM chunks WHERE {USABLE_SQL} ORDER BY chunk_id LIMIT 1)"


def _one_vector(t: Tables) -> list[float]:
    return t.chunks.where(vector.usable(F.col("embedding"), 64)).orderBy("chunk_id").limit(1).collect()[0].embedding


@query(f"""
    SELECT chunk_id, round(list_inner_product(embedding::DOUBLE[], {_ONE}), 6) AS score
    FROM chunks WHERE {USABLE_SQL} ORDER BY list_inner_product(embedding::DOUBLE[], {_ONE}) DESC, chunk_id LIMIT 10
""")
def vector_topk(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vector.top_k(t.chunks, _one_vector(t), 10, "chunk_id", "embedding").select("chunk_id", r6(F.col("score"), "score"))


@query(f"""
    SELECT chunk_id, round(list_inner_product(embedding::DOUBLE[], {_ONE}), 6) AS score
    FROM chunks WHERE {USABLE_SQL} AND document_id IN (SELECT doc_id FROM documents WHERE service_name IN {_SERVICES_SQL})
    ORDER BY list_inner_product(embedding::DOUBLE[], {_ONE}) DESC, chunk_id LIMIT 10
""")
def vector_topk_filtered(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return vector.top_k(search.filtered(t.chunks, t.documents, SERVICES), _one_vector(t), 10, "chunk_id", "embedding").select("chunk_id", r6(F.col("score"), "score"))


@query(f"""
    WITH v AS (SELECT chunk_id AS id, embedding::DOUBLE[] AS v FROM chunks WHERE {USABLE_SQL}),
    s AS (SELECT a.id AS query_id, b.id AS id, round(list_inner_product(a.v, b.v), 9) AS score FROM v a CROSS JOIN v b WHERE a.id % 20 = 0 AND b.id % 7 <> 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10
""")
def vector_topk_lists(spark, sf_dir):
    """The neighbours of every chunk whose id is divisible by 20, by lists around centres and with a filter on what may be found."""
    t = Tables(spark, sf_dir)
    corpus = t.spread("chunks").select(F.col("chunk_id").alias("id"), F.col("embedding").alias("vector"))
    lists = ann.ListedVectors.write(corpus, shared_path(spark, "lists"), 64)
    asked = corpus.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    found = lists.search(asked, 10, allowed=corpus.where("id % 7 <> 0").select("id"))
    return found.select("query_id", "id", r6(F.col("score"), "score"), "rank")


@query("""
    WITH v AS (SELECT CAST(vec_id AS BIGINT) AS id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT a.id AS query_id, b.id AS id, round(list_inner_product(a.v, b.v), 9) AS score FROM v a CROSS JOIN v b WHERE a.id <> b.id),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s)
    SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 5
""")
def vector_topk_batch(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return vector.top_k_batch(e.withColumnRenamed("id", "query_id"), e, 5, 64, keep_self=False).select("query_id", "id", r6(F.col("score"), "score"), "rank")


@query(f"""
    SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 64 THEN 'dimension' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'not finite'
                WHEN {USABLE_SQL} THEN 'usable' ELSE 'zero' END AS state, count(*) AS chunks
    FROM chunks GROUP BY 1
""")
def null_embedding_filter(spark, sf_dir):
    return Tables(spark, sf_dir).chunks.groupBy(vector.state(F.col("embedding"), 64).alias("state")).agg(F.count("*").alias("chunks"))


@query(f"WITH {POSTINGS_SQL} SELECT chunk_id, term, pos, weight FROM postings")
def postings(spark, sf_dir):
    return keyword.postings(Tables(spark, sf_dir).spread("chunks"))


@query(f"WITH {POSTINGS_SQL} SELECT term, count(DISTINCT chunk_id) AS records, count(*) AS occurrences FROM postings GROUP BY 1")
def term_stats(spark, sf_dir):
    return keyword.term_stats(stored_postings(Tables(spark, sf_dir)).all())


def _hits(t: Tables, asked):
    terms = materialize(keyword.query_terms(asked), "terms")
    return keyword.hits(stored_postings(t).of(terms), terms)


@query(f"WITH {REQUESTS_SQL}, {POSTINGS_SQL}, {TERMS_SQL}, {HITS_SQL} SELECT DISTINCT query_id, chunk_id FROM hits")
def keyword_match_and(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return keyword.matches(_hits(t, requests(t)))


@query(f"WITH requests AS (SELECT CAST(1 AS BIGINT) AS query_id, 'bucket' AS query), {POSTINGS_SQL} SELECT chunk_id, round(sum(CASE weight WHEN 'A' THEN 1.0 ELSE 0.4 END), 6)::DOUBLE AS score FROM postings WHERE term = 'bucket' GROUP BY 1")
def keyword_rank_single_term(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = spark.createDataFrame([(1, "bucket")], "query_id long, query string")
    return keyword.cover_density(_hits(t, one)).select("chunk_id", r6(F.col("score"), "score"))


@query(f"WITH {REQUESTS_SQL}, {POSTINGS_SQL}, {TERMS_SQL}, {HITS_SQL}, {COVER_SQL} SELECT query_id, chunk_id, round(score, 6) AS score FROM cover")
def keyword_rank_cover_density(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return keyword.cover_density(_hits(t, requests(t))).select("query_id", "chunk_id", r6(F.col("score"), "score"))


@query(f"""
    WITH {REQUESTS_SQL}, {POSTINGS_SQL}, {TERMS_SQL}, {HITS_SQL}, {COVER_SQL},
    mine AS (SELECT c.query_id, c.chunk_id, c.score FROM cover c JOIN chunks k USING (chunk_id) JOIN documents d ON d.doc_id = k.document_id WHERE d.service_name IN {_SERVICES_SQL}),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM mine)
    SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10
""")
def keyword_topk_filtered(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = search.keyword_arm(requests(t), search.filtered(t.chunks, t.documents, SERVICES), 10, stored_postings(t), subset=True)
    return found.select("query_id", "chunk_id", r6(F.col("score"), "score"), "rank")


@query()
def keyword_topk_english(spark, sf_dir):
    t = Tables(spark, sf_dir)
    posted = keyword.stemmed(stored_postings(t).all())
    stems = keyword.stemmed(materialize(keyword.query_terms(requests(t)), "terms"))
    # stems that two words of a query share are one term
    stems = stems.groupBy("query_id", "term").agg(F.min("term_no").alias("term_no"))
    order, every = Window.partitionBy("query_id").orderBy("term_no"), Window.partitionBy("query_id")
    stems = stems.withColumn("term_no", F.row_number().over(order) - 1).withColumn("n_terms", F.count("*").over(every).cast("int"))
    return keyword.top_k(keyword.cover_density(keyword.hits(posted, stems)), 10).select("query_id", "chunk_id", r6(F.col("score"), "score"), "rank")


_LISTS_SQL = """
    v AS (SELECT CAST(1 AS BIGINT) AS query_id, chunk_id, row_number() OVER (ORDER BY token_count DESC NULLS LAST, chunk_id) AS rank FROM chunks QUALIFY rank <= 100),
    k AS (SELECT CAST(1 AS BIGINT) AS query_id, chunk_id, row_number() OVER (ORDER BY length(text) DESC NULLS LAST, chunk_id) AS rank FROM chunks QUALIFY rank <= 100),
    stacked AS (SELECT query_id, chunk_id, rank AS vr, NULL AS kr FROM v UNION ALL SELECT query_id, chunk_id, NULL, rank FROM k),
    f AS (SELECT query_id, chunk_id, coalesce(1.0::DOUBLE / (60 + min(vr)), 0) + coalesce(1.0::DOUBLE / (60 + min(kr)), 0) AS score, CAST(min(vr) AS INTEGER) AS vector_rank, CAST(min(kr) AS INTEGER) AS keyword_rank FROM stacked GROUP BY 1, 2),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM f)"""


def _two_lists(t: Tables):
    """Two ranked lists: the chunks of most tokens, and of the longest texts."""
    c = t.chunks.select("chunk_id", "token_count", F.length("text").alias("n")).withColumn("query_id", F.lit(1).cast("long"))
    ranked = lambda by: c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last(by), "chunk_id"))).where("rank <= 100")
    return ranked("token_count"), ranked("n")


@query(f"WITH {_LISTS_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, vector_rank, keyword_rank, rank FROM r WHERE rank <= 10")
def rrf_fusion(spark, sf_dir):
    return fusion.rrf(*_two_lists(Tables(spark, sf_dir)), top_k=10).withColumn("score", F.round("score", 9))


@query(f"WITH {_LISTS_SQL} SELECT query_id, chunk_id, round(score, 9) AS score, vector_rank, keyword_rank, rank FROM r")
def rrf_fusion_topk0(spark, sf_dir):
    return fusion.rrf(*_two_lists(Tables(spark, sf_dir)), top_k=0).withColumn("score", F.round("score", 9))


@query(HYBRID_SQL + "SELECT query_id, chunk_id, round(score, 6) AS score, vector_rank, keyword_rank, rank, score_kind FROM results")
def hybrid_search(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.hybrid(embedded_requests(t), t.spread("chunks"), 10, index=stored_postings(t)).select("query_id", "chunk_id", r6(F.col("score"), "score"), "vector_rank", "keyword_rank", "rank", "score_kind")


@query(f"WITH {REQUESTS_SQL}, {POSTINGS_SQL}, {TERMS_SQL}, {HITS_SQL}, {COVER_SQL} SELECT query_id, chunk_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank, 'keyword' AS score_kind FROM ranked_kw WHERE rank <= 10")
def hybrid_keyword_fallback(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.fallback(requests(t), t.chunks, 10, stored_postings(t)).select("query_id", "chunk_id", r6(F.col("score"), "score"), "rank", "score_kind")


@query(HYBRID_SQL + """
    SELECT r.query_id, r.chunk_id, r.rank, c.document_id, c.chunk_index, c.chunk_type, c.section_path, c.text, d.url, d.service_name, d.title
    FROM results r JOIN chunks c USING (chunk_id) JOIN documents d ON d.doc_id = c.document_id
""")
def enrich_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = search.enrich(search.hybrid(embedded_requests(t), t.spread("chunks"), 10, index=stored_postings(t)), t.chunks, t.documents)
    return found.select("query_id", "chunk_id", "rank", "document_id", "chunk_index", "chunk_type", "section_path", "text", "url", "service_name", "title")


@query(f"""
    WITH {FIXED_SQL}, {VECTOR_ARM_SQL},
    r AS (SELECT query_id, chunk_id, rank AS vector_rank FROM ranked_vec WHERE rank <= 10)
    SELECT query_id, chunk_id, CAST(vector_rank AS INTEGER) AS vector_rank, 0 AS keyword_rank FROM r
""")
def missing_ranks(spark, sf_dir):
    t = Tables(spark, sf_dir)
    arm = search.vector_arm(embedded_requests(t).where("vector IS NOT NULL"), t.chunks, 10, 64)
    return search.missing_ranks(fusion.rrf(arm, arm.limit(0), 0)).select("query_id", "chunk_id", "vector_rank", "keyword_rank")


@query("""
    WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT a.vec_id AS q, b.vec_id AS id, a.label = b.label AS same, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.v, b.v), 9) DESC, b.vec_id) AS rank FROM v a CROSS JOIN v b WHERE a.vec_id <> b.vec_id),
    h AS (SELECT q, max(CASE WHEN same THEN 1 ELSE 0 END) AS hit FROM s WHERE rank <= 5 GROUP BY 1)
    SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS recall FROM h
""")
def recall_at_5(spark, sf_dir):
    e = Tables(spark, sf_dir).embeddings
    v = e.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    near = vector.top_k_batch(v.withColumnRenamed("id", "query_id"), v, 5, 64, keep_self=False)
    labels = e.select(F.col("vec_id").cast("long").alias("id"), "label")
    # the relevant rows among the neighbours stand for all relevant rows: others cannot be hit
    same = near.join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("label").alias("wanted")), "query_id").where("label = wanted").select("query_id", "id")
    asked = v.select(F.col("id").alias("query_id"))
    hit = near.join(same, ["query_id", "id"], "left_semi").select("query_id").distinct().withColumn("hit", F.lit(1))
    return asked.join(hit, "query_id", "left").agg(F.count("*").alias("queries"), F.count("hit").alias("hits"), r6(F.count("hit") / F.count("*"), "recall"))


@query("""
    WITH wanted AS (SELECT item_id, unnest(expected) AS chunk_id FROM eval_item), found AS (SELECT item_id, CAST(1 + (item_id % 24) AS INTEGER) AS chunk_id FROM eval_item),
    h AS (SELECT i.item_id, max(CASE WHEN w.chunk_id = f.chunk_id THEN 1 ELSE 0 END) AS hit FROM eval_item i JOIN found f USING (item_id) JOIN wanted w USING (item_id) GROUP BY 1)
    SELECT count(*) AS queries, CAST(sum(hit) AS BIGINT) AS hits, round(avg(hit), 6) AS recall FROM h
""")
def recall_of_expected(spark, sf_dir):
    items = Tables(spark, sf_dir).eval_item
    wanted = items.select(F.col("item_id").alias("query_id"), F.explode("expected").alias("id"))
    found = items.select(F.col("item_id").alias("query_id"), (1 + F.col("item_id") % 24).cast("int").alias("id"))
    return stats.recall_at_k(found, wanted).withColumn("recall", F.round("recall", 6))


@query(f"""
    WITH {REQUESTS_SQL}, {POSTINGS_SQL}, {TERMS_SQL}, {HITS_SQL}, {COVER_SQL},
    phrased AS (SELECT r.query_id, d.doc_id FROM requests r JOIN documents d ON contains(lower(d.text), lower(r.query)) WHERE trim(coalesce(r.query, '')) <> ''),
    wanted AS (SELECT DISTINCT p.query_id, c.chunk_id FROM phrased p JOIN chunks c ON c.document_id = p.doc_id),
    near AS (SELECT query_id, chunk_id FROM ranked_kw WHERE rank <= 5),
    judged AS (SELECT query_id, max(CASE WHEN n.chunk_id IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM wanted w LEFT JOIN near n USING (query_id, chunk_id) GROUP BY 1)
    SELECT count(*) AS queries, CAST(coalesce(sum(hit), 0) AS BIGINT) AS hits, round(avg(hit), 6) AS recall FROM judged
""")
def keyword_recall_at_5(spark, sf_dir):
    """Of the requests whose very words some document holds, those that the keyword arm answers with a chunk of such a document."""
    t = Tables(spark, sf_dir)
    asked = requests(t)
    phrased = t.documents.select("doc_id", F.lower("text").alias("low")).join(F.broadcast(asked.where("trim(query) != ''")), F.contains("low", F.lower("query"))).select("query_id", "doc_id")
    wanted = phrased.join(t.chunks.select(F.col("document_id").alias("doc_id"), F.col("chunk_id").alias("id")), "doc_id").select("query_id", "id").distinct()
    near = search.keyword_arm(asked, t.chunks, 5, stored_postings(t)).select("query_id", F.col("chunk_id").alias("id"))
    return stats.recall_at_k(near, materialize(wanted, "wanted")).withColumn("recall", F.round("recall", 6))


@query("SELECT chunk_id, document_id FROM chunks WHERE document_id IN (SELECT doc_id FROM documents WHERE service_name = 'queuely')")
def semi_join_filter(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return search.filtered(t.chunks, t.documents, ["queuely"]).select("chunk_id", "document_id")


@query("SELECT chunk_id, metadata['language'] AS language FROM chunks WHERE metadata IS NOT NULL AND cardinality(metadata) > 0")
def metadata_decode(spark, sf_dir):
    return Tables(spark, sf_dir).chunks.where("metadata IS NOT NULL AND size(metadata) > 0").select("chunk_id", F.try_element_at("metadata", F.lit("language")).alias("language"))


@query()
def embed_hashing(spark, sf_dir):
    return embed(Tables(spark, sf_dir).spread("chunks").select("chunk_id", "text"))


@query()
def search_by_text(spark, sf_dir):
    """Requests and chunks embedded by the same model, searched whole."""
    t = Tables(spark, sf_dir)
    asked = embed(requests(t), "query", "vector", query=True)
    return search.hybrid(asked, embed(t.chunks.drop("embedding")), 10, index=stored_postings(t))


