import functools
import http.server
import json
import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom import session
from fathom.operators import ann, answer, api, fusion, keyword, search, stats, vector
from fathom.operators.embed import QUERY_PREFIX, HashingEmbedder, ServiceEmbedder, embed


def ranked(spark, ids):
    return spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id long, chunk_id long, rank int")


@pytest.mark.parametrize(
    ("vec", "kw", "k", "order"),
    [([1, 2, 3], [2, 4, 1], 10, [2, 1, 4, 3]), ([10], [10], 10, [10]), ([], [], 5, []), ([1], [], 5, [1]), ([], [1], 5, [1]), ([1, 2, 3], [4, 5], 2, [1, 4]), ([1, 2], [], 0, [1, 2]), ([100, 42, 101], [42, 200, 201], 0, [42, 100, 200, 101, 201])],
)
def test_fusion(spark, vec, kw, k, order):
    rows = fusion.rrf(ranked(spark, vec), ranked(spark, kw), k).orderBy("rank").collect()
    assert [r.chunk_id for r in rows] == order
    for r in rows:
        want = (1 / (60 + vec.index(r.chunk_id) + 1) if r.chunk_id in vec else 0) + (1 / (60 + kw.index(r.chunk_id) + 1) if r.chunk_id in kw else 0)
        assert math.isclose(r.score, want, abs_tol=1e-12)
        assert (r.vector_rank is None) == (r.chunk_id not in vec)


def scores(spark, path, text, query):
    chunks = spark.createDataFrame([(1, path, text)], "chunk_id long, section_path string, text string")
    asked = spark.createDataFrame([(1, query)], "query_id long, query string")
    hit = keyword.hits(keyword.postings(chunks), keyword.query_terms(asked))
    return [r.score for r in keyword.cover_density(hit).collect()]


def test_cover_density(spark):
    assert scores(spark, None, "bucket policy", "bucket policy") == [pytest.approx(0.4)]
    assert scores(spark, None, "bucket big policy", "bucket policy") == [pytest.approx(0.4 / 2)]
    # a path word weighs 1: two hits, harmonic mean of 1 and 0.4, next to each other
    assert scores(spark, "bucket", "policy", "bucket policy") == [pytest.approx(2 / (1 + 2.5))]
    # single term: sum of weights
    assert scores(spark, "bucket", "bucket bucket", "bucket") == [pytest.approx(1.8)]
    # covers policy-bucket and bucket-policy
    assert scores(spark, "", "policy bucket policy", "bucket policy") == [pytest.approx(0.8)]
    # stop words keep their positions
    assert scores(spark, "", "bucket of the policy", "bucket policy") == [pytest.approx(0.4 / 3, abs=1e-9)]
    assert scores(spark, "", "bucket only", "bucket policy") == []
    assert scores(spark, "", "of the", "of the") == []
    assert scores(spark, None, None, "x") == []


def test_vectors(spark):
    bad = [None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 0.0], [None, 1.0]]
    rows = [(i, v) for i, v in enumerate([[1.0, 0.0], [0.0, 1.0], [0.8, 0.6], [0.8, 0.6], *bad])]
    df = spark.createDataFrame(rows, "id long, v array<float>")
    assert [r.id for r in vector.top_k(df, [1.0, 0.0], 3, "id", "v").collect()] == [0, 2, 3]
    states = {r.s: r["count"] for r in df.groupBy(vector.state(F.col("v"), 2).alias("s")).count().collect()}
    assert states == {"usable": 4, "null": 1, "dimension": 1, "zero": 1, "not finite": 3}
    asked = df.select(F.col("id").alias("query_id"), F.col("v").alias("vector"))
    got = vector.top_k_batch(asked, df.withColumnRenamed("v", "vector"), 2, 2, keep_self=False)
    best = {r.query_id: r.id for r in got.where("rank = 1").collect()}
    assert best == {0: 2, 1: 2, 2: 3, 3: 2}
    assert vector.top_k_batch(asked.limit(0), df.withColumnRenamed("v", "vector"), 2, 2).count() == 0


def test_batch_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "id long, vector array<double>").repartition(3)
    got = {(r.query_id, r["rank"]): r.id for r in vector.top_k_batch(df.withColumnRenamed("id", "query_id"), df, 3, 8).collect()}
    order = np.argsort(-(x @ x.T), 1)[:, :3]
    assert got == {(q, k + 1): order[q, k] for q in range(60) for k in range(3)}


@pytest.fixture
def corpus(spark):
    documents = spark.createDataFrame([(1, "u1", "s3", "Buckets"), (2, "u2", "iam", "Roles")], "doc_id long, url string, service_name string, title string")
    rows = [(10, 1, 0, "bucket policy text", "A", [1.0, 0.0]), (11, 1, 1, "other words", "", [0.0, 1.0]), (12, 2, 0, "role policy", None, [0.6, 0.8]), (13, 99, 0, "bucket policy orphan", "", None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, chunk_index int, text string, section_path string, embedding array<float>").withColumn("chunk_type", F.lit("prose")).withColumn("token_count", F.lit(3))
    return documents, chunks


def test_hybrid_and_fallback(spark, corpus):
    documents, chunks = corpus
    asked = spark.createDataFrame([(1, "bucket policy", [1.0, 0.0]), (2, "role", None)], "query_id long, query string, vector array<float>")
    rows = {(r.query_id, r.chunk_id): r for r in search.hybrid(asked, chunks, 3, dim=2).collect()}
    assert rows[1, 10].score == pytest.approx(2 / 61) and rows[1, 10].score_kind == "rrf"
    assert rows[2, 12].score_kind == "keyword" and rows[2, 12].score == pytest.approx(0.4)
    named = search.enrich(search.hybrid(asked, chunks, 3, dim=2), chunks, documents)
    assert {r.chunk_id for r in named.where("query_id = 1").collect()} == {10, 12}  # 13 has no document
    assert search.filtered(chunks, documents, ["iam"]).count() == 1 and search.filtered(chunks, documents, []).count() == 4


def test_broken_arm_leaves_the_other(spark, corpus):
    _, chunks = corpus
    asked = spark.createDataFrame([(1, "bucket policy", [1.0, 0.0])], "query_id long, query string, vector array<float>")
    rows = search.hybrid(asked, chunks.drop("embedding"), 3, dim=2).collect()
    assert {r.chunk_id for r in rows} == {10, 13} and all(r.vector_rank is None for r in rows)
    with pytest.raises(RuntimeError):
        search.run_arms(asked, chunks.drop("embedding", "text"), 3, 2)


def test_citations(spark):
    chunks = spark.createDataFrame([(1, i, 100 + i, "x" * 300, "u", "t", "s", None, 0.5) for i in range(1, 6)], "query_id long, rank int, chunk_id long, text string, url string, title string, service_name string, section_path string, score double")
    answers = spark.createDataFrame([(1, "[1] [3], [5][1] [0] [99] [s3 > x] [99999999999]")], "query_id long, answer string")
    got = answer.citations(answers, chunks).orderBy("cite_no").collect()
    assert [(r.chunk_id, r.ref_num) for r in got] == [(101, 1), (103, 3), (105, 5)] and len(got[0].text) == 203
    assert answer.citations(answers.withColumn("answer", F.lit("")), chunks).count() == 0


def test_answers(spark, corpus):
    documents, chunks = corpus
    asked = spark.createDataFrame([(1, "bucket policy", [1.0, 0.0]), (2, "nothing here", [1.0, 0.0])], "query_id long, query string, vector array<float>").where("query_id = 1")
    prompts = answer.prompts(search.enrich(search.hybrid(asked, chunks, 3, dim=2), chunks, documents), asked)
    user = prompts.first().user
    assert "### [1] s3 — Buckets\n**Section:** A\n**Source:** u1\n\nbucket policy text\n\n---\n" in user and user.endswith("## Question\n\nbucket policy")
    assert answer.answer(prompts).first().answer.startswith("bucket policy text [1]")

    class Broken:
        def complete(self, system, user):
            raise ValueError("no")

    assert tuple(answer.answer(prompts, Broken).first())[1:] == (None, False, "no")


def test_markdown():
    text = "# Head\npara one\nstill\n\n- a\n* b\n1. c\n2) d\n```python\nx = 1\n\n# no head"
    assert answer.parse_blocks(text) == [("h", "Head", None, None, 1), ("p", "para one\nstill", None, None, None), ("ul", None, ["a", "b"], None, None), ("ol", None, ["c", "d"], None, None), ("code", "x = 1\n\n# no head", None, "python", None)]
    assert answer.parse_blocks(None) == [] and answer.parse_blocks("  \n") == []


def test_stats(spark, corpus):
    documents, chunks = corpus
    empty = documents.unionByName(spark.createDataFrame([(3, "u3", "sqs", "")], documents.schema))
    rows = {r.service_name: r for r in stats.with_share(stats.per_service(empty, chunks)).collect()}
    assert (rows["s3"].chunks, rows["sqs"].chunks) == (2, 0) and rows["s3"].share == pytest.approx(2 / 3) and rows["sqs"].bar == 0
    assert tuple(stats.totals(documents, chunks).first()) == (2, 4)
    none = stats.with_share(stats.per_service(documents, chunks.limit(0))).collect()
    assert all(r.share == 0 and r.bar == 0 for r in none)


def test_recall(spark):
    near = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "query_id long, id long")
    wanted = spark.createDataFrame([(1, 5), (2, 9), (3, 7), (4, 1)], "query_id long, id long")
    assert tuple(stats.recall_at_k(near, wanted).first()) == (4, 2, 0.5)


def test_fusion_below_a_self_join(spark):
    """Ranks stay unique when the fused list is used twice in one plan."""
    rows = [(q, c, (c * 7 + q) % 50) for q in range(20) for c in range(50)]
    base = spark.createDataFrame(rows, "query_id long, chunk_id long, v int")
    from pyspark.sql.window import Window

    rank = lambda by: base.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(by, "chunk_id"))).where("rank <= 30")
    fused = fusion.rrf(rank("v"), rank(F.desc("chunk_id")), 10)
    top = fused.groupBy("query_id").agg(F.max("rank").alias("rank"))
    assert fused.join(top.withColumn("rank", F.explode(F.sequence(F.lit(1), F.col("rank")))), ["query_id", "rank"]).count() == 200


def test_keyword_index_gives_what_the_texts_give(spark, tmp_path):
    rows = [(i, "bucket" if i % 3 else None, f"policy of the bucket {'queue ' * (i % 4)} role{i}") for i in range(60)] + [(100, None, None), (101, "", "")]
    chunks = spark.createDataFrame(rows, "chunk_id long, section_path string, text string")
    posted = keyword.postings(chunks)
    stored = keyword.KeywordIndex.write(posted, str(tmp_path / "index"), buckets=4, parts=2)
    assert sorted(map(tuple, stored.all().select(posted.columns).collect())) == sorted(map(tuple, posted.collect()))
    asked = spark.createDataFrame([(1, "bucket policy"), (2, "role7"), (3, "of the"), (4, "nowhere")], "query_id long, query string")
    terms = keyword.query_terms(asked)
    want = sorted(map(tuple, keyword.cover_density(keyword.hits(posted, terms)).collect()))
    assert sorted(map(tuple, keyword.cover_density(keyword.hits(stored.of(terms), terms)).collect())) == want and len(want) == 61
    stored.LITERAL_TERMS = 1
    assert sorted(map(tuple, keyword.cover_density(keyword.hits(stored.of(terms), terms)).collect())) == want
    assert stored.of(terms.limit(0)).count() == 0
    few = search.keyword_arm(asked, chunks.where("chunk_id < 10"), 100, stored, subset=True).collect()
    assert {r.chunk_id for r in few if r.query_id == 1} == set(range(10))


def test_an_arm_whose_job_fails_leaves_the_other(spark):
    chunks = spark.createDataFrame([(1, None, "bucket policy", [1.0, 0.0])], "chunk_id long, section_path string, text string, embedding array<float>")
    asked = spark.createDataFrame([(1, "bucket", [1.0, 0.0])], "query_id long, query string, vector array<float>")
    broken = chunks.withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    rows = search.hybrid(asked, broken, 3, dim=2).collect()
    assert [(r.chunk_id, r.vector_rank, r.keyword_rank) for r in rows] == [(1, 1, None)]
    with pytest.raises(RuntimeError):
        search.hybrid(asked.withColumn("vector", F.lit(None).cast("array<float>")), broken, 3, dim=2)


def test_best_places_breaks_ties_by_id():
    rng = np.random.default_rng(2)
    score, ids = rng.integers(0, 4, (30, 50)).astype(float), rng.permutation(50)
    score[3] = -np.inf
    q, d = vector.best_places(score, ids, 6)
    for row in range(30):
        want = sorted(range(50), key=lambda c: (-score[row, c], ids[c]))[:6] if row != 3 else []
        assert d[q == row].tolist() == want
    assert len(vector.best_places(score[:, :4], ids[:4], 6)[0]) == 29 * 4


def test_hashing_embedder_is_lexical():
    e = HashingEmbedder(64)
    x = e.encode(["the queue of a role", "The QUEUE, of a role!", "bucket policy", "", None])
    assert np.allclose(x[0], x[1]) and x[0] @ x[2] < 0.5 and not x[3].any() and not x[4].any()
    assert np.allclose(np.linalg.norm(x[:3], axis=1), 1) and np.allclose(e.encode(["bucket policy"])[0], x[2])
    assert e.encode([]).shape == (0, 64)


def test_service_embedder(spark):
    asked, failing = [], [2]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            text = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["text"]
            asked.append(text)
            if text == "busy" and failing[0]:
                failing[0] -= 1
                code, body = 503, {}
            elif text == "bad":
                code, body = 500, {}
            else:
                code, body = 200, {"embedding": [len(text), 1.0], "dimension": 2}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(body).encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        make = functools.partial(ServiceEmbedder, f"http://127.0.0.1:{server.server_port}/embed", 2, timeout=5, pause=0.01)
        assert make().encode(["busy", " ", "ab"]).tolist() == [[4.0, 1.0], [0.0, 0.0], [2.0, 1.0]] and asked.count("busy") == 3
        assert make().encode(["q"], query=True).tolist() == [[len(QUERY_PREFIX) + 1.0, 1.0]]
        with pytest.raises(RuntimeError):
            make().encode(["bad"])
        df = spark.createDataFrame([(1, "ab"), (2, "bad"), (3, None), (4, "abc")], "id int, text string").coalesce(1)
        got = {r.id: r.embedding for r in embed(df, factory=make, batch=1).collect()}
        assert got == {1: [2.0, 1.0], 2: None, 3: None, 4: [3.0, 1.0]}
    finally:
        server.shutdown()


def test_listed_vectors_find_what_an_exact_search_finds(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    x = (centres[rng.integers(0, 12, 600)] + rng.normal(size=(600, 8)) * 0.15) * rng.uniform(0.5, 2, (600, 1))
    x[5] = x[4]
    bad = [(1000, None), (1001, [1.0]), (1002, [0.0] * 8), (1003, [float("nan")] * 8), (None, x[0].tolist())]
    corpus = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *bad], "id long, vector array<float>")
    lists = ann.ListedVectors.write(corpus, str(tmp_path / "lists"), 8, list_rows=40)
    asked = corpus.where("id % 9 = 0 OR id > 900").withColumnRenamed("id", "query_id")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    want = key(vector.top_k_batch(asked, corpus, 6, 8))
    assert key(lists.search(asked, 6)) == want and len(want) == 67 * 6
    some = corpus.where("id IN (3, 7, 100)").select("id")
    assert key(lists.search(asked, 6, some)) == key(vector.top_k_batch(asked, corpus.where("id IN (3, 7, 100)"), 6, 8))
    none = ann.ListedVectors.write(corpus.limit(0), str(tmp_path / "none"), 8)
    assert none.search(asked, 6).count() == 0 and lists.search(asked.limit(0), 6).count() == 0


def test_listed_vectors_write_little_however_many_lists_a_query_wants(spark, tmp_path, monkeypatch):
    """Vectors that do not cluster: nearly all lists are wanted, and no query is written once for each of them."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 32))
    x = x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.9, 1, (3000, 1))
    x[70:80], x[80:90] = x[60], x[80:90] * 1e-3
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>").repartition(3)
    lists = ann.ListedVectors.write(corpus, str(tmp_path / "lists"), 32, list_rows=20)
    asked = corpus.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    allowed = corpus.where("id % 7 <> 0")
    key = lambda df: sorted((r.query_id, r["rank"], r.id, r.score) for r in df.collect())
    want = key(vector.top_k_batch(asked, allowed, 4, 32))
    for at in ("whole", "parts"):
        monkeypatch.setattr(session, "shared_dir", lambda spark, at=at: f"file://{tmp_path / at}")
        assert key(lists.search(asked, 4, allowed.select("id"))) == want, at
        written = sum(f.stat().st_size for f in (tmp_path / at).rglob("*.parquet"))
        assert written < 1_500_000, (at, written)
        monkeypatch.setattr(ann, "BROADCAST_BYTES", 16000)  # in four passes
        monkeypatch.setattr(ann, "HITS", 500, raising=False)


def test_api(spark, corpus):
    documents, chunks = corpus
    documents = documents.withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    post = lambda i, body, at=0: (i, "a", at, "POST", "/api/v1/search", body)
    rows = [
        post(1, '{"query": "bucket policy", "top_k": 1}'), post(2, '{"query": "bucket policy", "services": ["iam"], "stream": true}'), post(3, "{", 1), post(4, None, 1), post(5, '{"query": " "}', 2), post(6, '{"query": "x", "top_k": 0}', 2),
        (7, "b", 0, "GET", "/api/v1/stats", None), (8, "b", 0, "GET", "/healthz", None), (9, "b", 0, "GET", "/readyz", None), (10, "b", 0, "GET", "/x", None), (11, "b", 0, "DELETE", "/api/v1/stats", None), (12, "c", 0, "GET", "/api/v1/stats", None), (13, "c", 0, "GET", "/api/v1/stats", None), (14, "c", 0, "GET", "/api/v1/stats", None),
        post(15, '{"query": "zzz qqq", "services": ["none"]}', 9),
    ]
    calls = spark.createDataFrame(rows, "request_id long, client string, at int, method string, path string, body string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    make = functools.partial(HashingEmbedder, 2)
    got = {r.request_id: r for r in api.responses(calls, embed(chunks, factory=make), documents, 2, make, ready={"index": "ok", "embedder": "down"}, rate=1.0, burst=2).collect()}
    assert {i: r.status for i, r in got.items()} == {1: 200, 2: 200, 3: 400, 4: 429, 5: 400, 6: 429, 7: 200, 8: 200, 9: 503, 10: 404, 11: 405, 12: 200, 13: 200, 14: 429, 15: 200}
    one = json.loads(got[1].response)
    assert one["metadata"]["chunks_found"] == 1 and len(one["citations"]) == 1 and one["answer"].endswith("[1]") and one["metadata"]["model"] == "extractive"
    assert got[2].content_type == "text/event-stream" and got[2].response.startswith("event: chunk\ndata: ") and got[2].response.endswith("event: done\n\n")
    assert json.loads(got[3].response) == {"error": "invalid request body"} and json.loads(got[5].response) == {"error": "query is required"} and json.loads(got[4].response) == {"error": "rate limit exceeded"}
    stats_of = json.loads(got[7].response)
    assert stats_of["total_chunks"] == chunks.count() and {s["service_name"] for s in stats_of["services"]} == {"s3", "iam"}
    assert json.loads(got[15].response)["citations"] == [] and json.loads(got[9].response)["embedder"] == "down"

    class Broken:
        def complete(self, system, user):
            raise ValueError("no")

    failed = {r.request_id: r for r in api.responses(calls.where("request_id < 3"), embed(chunks, factory=make), documents, 2, make, Broken).collect()}
    assert failed[1].status == 500 and json.loads(failed[1].response) == {"error": "generation failed"} and failed[2].response.startswith("event: error\n")
    upstream = spark.createDataFrame([(1, 200, "{}", "application/json"), (2, 500, "broken", "text/plain"), (3, 503, "", None), (4, None, None, None)], "request_id long, status int, response string, content_type string")
    passed = {r.request_id: (r.status, r.response) for r in api.proxied(upstream).collect()}
    assert passed == {1: (200, "{}"), 2: (502, '{"error":"broken"}'), 3: (502, '{"error":"Upstream returned 503"}'), 4: (502, '{"error":"Upstream request failed"}')}
