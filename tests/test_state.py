import datetime as dt
import hashlib
import os
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.operators import crawl, index, serving
from fathom.plans import ingest as ingest_plans
from fathom.schemas import initialize
from fathom.session import intermediates, materialize, shared_path
from fathom.sources import demo, tables
from fathom.streaming import ingest

T0 = dt.datetime(2024, 1, 1)


def test_changed_and_merged(spark):
    pages = spark.createDataFrame([("a", "h1", T0), ("b", "h2", T0), ("c", "h3", T0), ("d", None, T0)], "url string, content_hash string, crawled_at timestamp")
    state = spark.createDataFrame([("a", "h1", T0), ("b", "old", T0), ("b", "h2", T0 - dt.timedelta(1)), ("d", None, T0), (None, "h", T0)], "url string, content_hash string, last_crawled_at timestamp")
    assert {r.url for r in index.changed(pages, state).collect()} == {"b", "c", "d"}
    merged = {r.url: r.content_hash for r in index.merge_state(state, pages).collect()}
    assert merged == {"a": "h1", "b": "h2", "c": "h3", "d": None}
    assert index.changed(pages.limit(0), state).count() == 0


def test_seeds_and_lists(spark, tmp_path):
    (tmp_path / "urls").write_text("# list\n\n  https://a/ \nhttps://b/\n   # more\n")
    assert [r.url for r in tables.url_list(spark, str(tmp_path / "urls")).collect()] == ["https://a/", "https://b/"]
    assert [r.service for r in tables.seeds(spark, ["S3", "none"]).collect()] == ["s3"] and tables.seeds(spark).count() == 15
    a = spark.createDataFrame([("x", 1), ("y", 2)], "url string, position int")
    b = spark.createDataFrame([("y", 1), ("z", 2)], "url string, position int")
    assert {r.url: r.position for r in index.merge_unique(a, b).collect()} == {"x": 1, "y": 2, "z": 3}


def test_store(spark, tmp_path):
    store = index.VersionedStore(spark, f"file://{tmp_path}/store")
    assert store.version() == 0 and store.read("documents") is None
    assert initialize(spark, store) == 1 and initialize(spark, store) == 1
    docs = spark.createDataFrame([(1, "u", "t1"), (2, "v", "t2")], "doc_id long, url string, title string")
    chunks = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c")], "document_id long, chunk_index int, text string")
    index.upsert(store, docs, chunks)
    index.upsert(store, docs.where("doc_id = 1").withColumn("title", F.lit("new")), chunks.where("document_id = 1 AND chunk_index = 0"))
    assert {(r.doc_id, r.title) for r in store.read("documents").collect()} == {(1, "new"), (2, "t2")}
    assert store.read("chunks").count() == 2 and store.version() == 3


def test_crawl(spark):
    links = spark.createDataFrame([("https://h/a", "b#x"), ("https://h/a", "#top"), ("https://h/b", "/c/"), ("https://h/c", "javascript:x"), ("https://h/c", "https://h/a"), ("https://h/c", "https://other/x"), ("https://h/c", "/d.pdf"), ("https://h/c", None)], "page_url string, href string")
    seeds = spark.createDataFrame([("https://h/a",)], "url string")
    found = crawl.reachable(seeds, crawl.resolved_links(links), spark.createDataFrame([("https://h/",)], "prefix string"))
    assert {(r.url, r.depth) for r in found.collect()} == {("https://h/a", 0), ("https://h/b", 1), ("https://h/c", 2)}
    assert crawl.reachable(seeds.limit(0), crawl.resolved_links(links)).count() == 0


def test_crawl_goes_on_until_nothing_is_new(spark):
    links = spark.createDataFrame([(f"https://h/{i}", f"https://h/{i + 1}") for i in range(53)], "src string, dst string")
    seeds = spark.createDataFrame([("https://h/0",)], "url string")
    assert {(r.url, r.depth) for r in crawl.reachable(seeds, links).collect()} == {(f"https://h/{i}", i) for i in range(54)}
    with pytest.raises(RuntimeError):
        crawl.reachable(seeds, links, max_depth=2)


def test_crawl_in_scope_takes_the_whole_table(spark, tmp_path):
    docs = [("https://a.docs/x/1.html", "queuely"), ("https://b.docs/y/1.html", "keyward"), ("https://c.docs/z/1.html", None), (None, "keyward")]
    links = [("https://a.docs/x/1.html", "2.html"), ("https://b.docs/y/1.html", "sub/2.html"), ("https://b.docs/y/sub/2.html", "../3.html"), ("https://b.docs/y/3.html", "https://a.docs/x/4.html"), ("https://c.docs/z/1.html", "/z/2.html"), ("https://c.docs/z/2.html", "/out.html"), ("https://c.docs/z/2.html", "5.pdf"), ("https://b.docs/y/9.html", "10.html"), (None, "2.html"), ("https://c.docs/z/1.html", None)]
    spark.createDataFrame([(i, *d) for i, d in enumerate(docs)], "doc_id long, url string, service_name string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(links, "page_url string, href string").write.parquet(str(tmp_path / "page_link.parquet"))
    want, level = {}, {u for u, _ in docs if u}
    scope = tuple(u.rsplit("/", 1)[0] for u in level)
    while level:
        want |= {u: max(want.values(), default=-1) + 1 for u in level}
        level = {v for p, h in links if p in level and h and (v := urljoin(p, h)).startswith(scope) and not v.endswith(".pdf")} - set(want)
    assert len(want) == 8 and {r.url: r.depth for r in ingest_plans.crawl_in_scope(spark, str(tmp_path)).collect()} == want


def test_caches():
    now = [0.0]
    cache = serving.SearchCache(2, 10, lambda: now[0])
    cache.put_retrieval("a", [1])
    cache.put_retrieval("e", [])
    cache.put_answer("a", "")
    cache.put_answer("x", "half", RuntimeError())
    assert cache.retrievals.get("a") == [1] and cache.retrievals.get("e") is None
    assert cache.answers.get("a") == "" and cache.answers.get("x") is None
    now[0] = 10.0
    assert cache.retrievals.get("a") is None
    for k in "bcd":
        cache.put_retrieval(k, [k])
    assert cache.retrievals.get("b") is None and cache.retrievals.get("d") == ["d"]
    assert serving.request_key("Q", 5, ["b", "a"]) == serving.request_key("q", 5, ["a", "b"]) != serving.request_key("q", 6, ["a", "b"])


def test_token_bucket(spark):
    times = np.array([0.0, 0.0, 0.0, 1.0, 1.1])
    assert serving.token_bucket(times, 1.0, 2, 2.0, 0.0)[0].tolist() == [True, True, False, True, False]
    log = spark.createDataFrame([(u, T0 + dt.timedelta(seconds=s), i) for i, (u, s) in enumerate([("a", 0), ("a", 0), ("a", 0), ("b", 0), ("a", 1)])], "u string, ts timestamp, id int")
    got = {r.id: r.allowed for r in serving.rate_limit(log, "u", "ts", "id", 1.0, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}
    waits = {r.id: r.wait for r in serving.admission(log, "u", "ts", "id", 1.0, 2).collect()}
    assert waits == {0: 0.0, 1: 0.0, 2: 1.0, 3: 0.0, 4: 1.0}
    assert serving.rate_limit(log.limit(0), "u", "ts", "id").count() == 0


def test_cache_replay(spark):
    log = spark.createDataFrame([("k", T0 + dt.timedelta(minutes=m)) for m in (0, 5, 14, 15, 29, 31)], "key string, ts timestamp")
    hits = [r.hit for r in serving.replay_cache(log).orderBy("ts").collect()]
    assert hits == [False, True, True, False, True, False]


def test_recent(spark):
    log = spark.createDataFrame([("a ", 1), ("b", 2), ("a", 3), (" ", 4), (None, 5)], "q string, t int")
    assert [r.query for r in serving.recent_queries(log, "q", "t").collect()] == ["a", "b"]


PAGE = "<html><head><title>{t}</title></head><body><main><h1>{t}</h1><p>{body}</p></main></body></html>"


def test_ingest_is_idempotent(spark, tmp_path):
    store = index.VersionedStore(spark, f"file://{tmp_path}/store")
    rows = [("u1", PAGE.format(t="One", body="First text here."), "s", T0), ("u1", PAGE.format(t="One", body="Newer text."), "s", T0 + dt.timedelta(1)), ("u2", "", "s", T0), (None, "x", "s", T0)]
    pages = spark.createDataFrame(rows, "url string, html string, service_name string, crawled_at timestamp")
    assert ingest.ingest_batch(store, pages) == 1
    first = [tuple(r) for r in store.read("chunks").select("chunk_id", "text").collect()]
    assert first[0][1] == "[One] Newer text." and len(first) == 1
    assert ingest.ingest_batch(store, pages) is None and store.version() == 1
    assert {r.url for r in store.read("crawl_state").collect()} == {"u1"}  # a page without chunks is not recorded


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([("a", T0 + dt.timedelta(seconds=s), i) for i, s in enumerate([0, 0, 0, 1])], "u string, ts timestamp, id int")
    log.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    limited = ingest.stream_rate_limit(source, "u", "ts", "id", 1.0, 2)
    q = limited.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: True}
    counted = ingest.windowed_counts(source, "ts", "u")
    q = counted.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.n for r in spark.table("counted").collect()] == [4]


def test_stream_of_pages(spark, tmp_path):
    rows = [("u1", PAGE.format(t="One", body="First text here."), "s", T0)]
    pages = spark.createDataFrame(rows, "url string, html string, service_name string, crawled_at timestamp")
    pages.write.parquet(str(tmp_path / "in"))
    store = index.VersionedStore(spark, f"file://{tmp_path}/store")
    q = ingest.stream_pages(spark.readStream.schema(pages.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert store.read("documents").first().title == "One"


def test_registry_runs_without_llm():
    from fathom.plans import registry

    assert set(registry.oracle_sql()) <= set(registry.queries()) and len(registry.queries()) > 60


def test_settings(spark):
    assert tables.Settings.of(spark).chunk_tokens == 512
    spark.conf.set("spark.fathom.chunk_tokens", "256")
    try:
        assert tables.Settings.of(spark).chunk_tokens == 256
    finally:
        spark.conf.unset("spark.fathom.chunk_tokens")




def test_update_rewrites_touched_buckets_only(spark, tmp_path):
    store = index.VersionedStore(spark, f"file://{tmp_path}/store", buckets=8)
    docs = spark.createDataFrame([(i, f"u{i}", "t") for i in range(40)], "doc_id long, url string, title string")
    chunks = spark.createDataFrame([(i, 0, "a") for i in range(40)], "document_id long, chunk_index int, text string")
    store.commit({"documents": docs, "chunks": chunks})
    before = store._manifest()["tables"]
    one = docs.where("doc_id = 7").withColumn("title", F.lit("new")).withColumn("lang", F.lit("en"))
    assert index.upsert(store, one, chunks.limit(0)) == 2
    after = store._manifest()["tables"]
    for name in ("documents", "chunks"):
        assert sum(before[name]["parts"].get(b) != after[name]["parts"].get(b) for b in map(str, range(8))) == 1
    rows = {r.doc_id: (r.title, r.lang) for r in store.read("documents").collect()}
    assert len(rows) == 40 and rows[7] == ("new", "en") and rows[8] == ("t", None)
    assert store.read("chunks").where("document_id = 7").count() == 0 and store.read("chunks").count() == 39
    assert store.read("documents", one).where("doc_id = 7").count() == 1 and store.read("documents", one).count() < 40


def test_a_commit_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    store = index.VersionedStore(spark, f"file://{tmp_path}/store", buckets=4)
    docs = spark.createDataFrame([(1, "u", "t1"), (2, "v", "t2")], "doc_id long, url string, title string")
    chunks = spark.createDataFrame([(1, 0, "a"), (2, 0, "c")], "document_id long, chunk_index int, text string")
    index.upsert(store, docs, chunks)
    old = [sorted(map(tuple, store.read(n).collect())) for n in ("documents", "chunks")]
    changed = (docs.where("doc_id = 1").withColumn("title", F.lit("new")), chunks.where("document_id = 1").withColumn("text", F.lit("z")))
    real = index.VersionedStore._write
    for broken in ("documents", "chunks", None):  # while a table is written, and before the manifest is in place

        def write(self, df, version, table, *rest, broken=broken):
            if table == broken:
                raise OSError("lost")
            return real(self, df, version, table, *rest)

        def publish(self, now):
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(index.VersionedStore, "_write", write)
            if broken is None:
                m.setattr(index.VersionedStore, "_publish", publish)
            with pytest.raises(OSError):
                index.upsert(store, *changed)
        again = index.VersionedStore(spark, f"file://{tmp_path}/store", buckets=4)
        assert again.version() == 1 and [sorted(map(tuple, again.read(n).collect())) for n in ("documents", "chunks")] == old
    assert index.upsert(store, *changed) == 2 and {r.title for r in store.read("documents").collect()} == {"new", "t2"}
    stale = index.VersionedStore(spark, f"file://{tmp_path}/store", buckets=4)
    monkeypatch.setattr(stale, "version", lambda: 1)
    with pytest.raises(RuntimeError):  # a writer that did not see version 2
        index.upsert(stale, *changed)


def test_numbered(spark):
    df = spark.createDataFrame([(i * 7 % 50, i % 3) for i in range(50)], "a int, b int")
    got = index.numbered(df, "a", "b").orderBy("position").collect()
    assert [r.position for r in got] == list(range(1, 51)) and [r.a for r in got] == sorted(r.a for r in got)
    assert index.numbered(df.limit(0), "a").count() == 0


def by_hand(rows, rate, burst):
    """(allowed, wait) of each request of one key, one after the other."""
    out, tokens, last, queue, now = [], burst, None, burst, None
    for t in rows:
        tokens, last = min(burst, tokens + (t - last) * rate) if last is not None else burst, t
        ok = tokens >= 1
        tokens -= ok
        start = t if now is None else max(t, now)
        queue, now = burst if now is None else min(burst, queue + (start - now) * rate), start
        if queue < 1:
            now += (1 - queue) / rate
            queue = 1.0
        queue -= 1
        out.append((ok, round(now - t, 6)))
    return out


def test_folds_over_busy_and_resting_keys(spark):
    """Logs are cut at rests and come in many batches; keys may be null."""
    rng = np.random.default_rng(8)
    rows, n = [], 0
    for key in ("busy", "calm", None, "late"):
        t = 0.0
        for _ in range(400 if key == "busy" else 60):
            t += float(rng.choice([0.0, 0.25, 0.5] if key == "busy" else [0.0, 0.5, 7.0, 40.0]))
            rows.append((key, T0 + dt.timedelta(seconds=t), n))
            n += 1
    log = spark.createDataFrame(rows, "u string, ts timestamp, id int").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        allowed = {r.id: r.allowed for r in serving.rate_limit(log, "u", "ts", "id", 1.0, 4).collect()}
        wait = {r.id: r.wait for r in serving.admission(log, "u", "ts", "id", 1.0, 4).collect()}
        hit = {r.id: r.hit for r in serving.replay_cache(log, "u", "ts", ttl=9.0, order="id").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for key in ("busy", "calm", None, "late"):
        mine = [(i, (ts - T0).total_seconds()) for u, ts, i in rows if u == key]
        want = by_hand([t for _, t in mine], 1.0, 4)
        assert [allowed[i] for i, _ in mine] == [ok for ok, _ in want] and [wait[i] for i, _ in mine] == pytest.approx([w for _, w in want])
        filled = -1e9
        for i, t in mine:
            assert hit[i] == (t - filled < 9.0), (key, t)
            filled = t if not hit[i] else filled


def test_lru_replay(spark):
    rng = np.random.default_rng(9)
    rows = [("ab"[i % 2], f"k{rng.integers(9)}", T0 + dt.timedelta(seconds=int(i * rng.integers(1, 3))), i) for i in range(300)]
    log = spark.createDataFrame(rows, "server string, key string, ts timestamp, id int")
    got = {r.id: r.hit for r in serving.replay_lru(log, "server", "key", "ts", "id", entries=4, ttl=40).collect()}
    for server in "ab":
        now = [0.0]
        cache = serving.TtlCache(4, 40, lambda now=now: now[0])
        for _, key, ts, i in sorted((r for r in rows if r[0] == server), key=lambda r: (r[2], r[3])):
            now[0] = (ts - T0).total_seconds()
            assert got[i] == (cache.get(key) is not None), i
            if not got[i]:
                cache.put(key, 1)


def test_demo(spark, tmp_path):
    store = index.VersionedStore(spark, f"file://{tmp_path}/store")
    initialize(spark, store)
    assert demo.seed_demo(store) == 2 and demo.seed_demo(store) == 3
    assert store.read("documents").count() == 5 and store.read("chunks").count() == 8
    row = store.read("documents").where("service_name = 'vpc'").first()
    texts = [r.text for r in store.read("chunks").where(F.col("document_id") == row.doc_id).orderBy("chunk_index").collect()]
    assert row.content_hash == hashlib.sha256("".join(texts).encode()).hexdigest()
    assert store.read("chunks").where("token_count > 0 AND size(embedding) = 64").count() == 8


def test_intermediates_are_dropped(spark):
    with intermediates(spark):
        path = materialize(spark.range(3), "x").inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "/")
        kept = shared_path(spark, "y", lasting=True)
        spark.range(2).write.parquet(kept)
        assert os.path.isdir(path)
    assert not os.path.isdir(path) and spark.read.parquet(kept).count() == 2
