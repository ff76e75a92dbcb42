import datetime as dt

from pyspark.sql import functions as F

from fathom import cli
from fathom.functions import presentation as P
from fathom.functions import wire
from fathom.plans import registry
from fathom.sources import tables


def decoded(spark, stream, how):
    return spark.createDataFrame([(stream,)], "x string").select(how(F.col("x")).alias("v")).first().v


def test_streams_of_models(spark):
    choices = 'data: {"choices":[{"delta":{"content":"He"}}]}\n\ndata: not json\n\ndata: {"choices":[]}\n\ndata: {"choices":[{"delta":{"content":"y"}}]}\n\ndata: [DONE]\n\ndata: {"choices":[{"delta":{"content":"late"}}]}\n'
    assert decoded(spark, choices, wire.choices_text) == "Hey"
    blocks = 'event: x\r\ndata: {"type":"content_block_delta","delta":{"type":"text_delta","text":"a"}}\r\n\r\ndata: {"type":"ping"}\n\ndata: {"type":"content_block_delta","delta":{"text":"b"}}\n\ndata: {"type":"message_stop"}\n\ndata: {"type":"content_block_delta","delta":{"text":"late"}}\n'
    assert decoded(spark, blocks, wire.blocks_text) == "ab"
    lines = '{"message":{"content":"x"},"done":false}\nbroken\n{"message":{"content":"y"},"done":true}\n{"message":{"content":"late"}}'
    assert decoded(spark, lines, wire.lines_text) == "xy"
    assert decoded(spark, "", wire.lines_text) == ""


def test_events_to_answer(spark):
    good = "event: chunk\ndata: one\n\nevent: chunk\ndata:  two\n\nevent: citations\ndata: []\n\nevent: done\n\n"
    assert decoded(spark, good, lambda c: wire.answer_of(P.sse_parse(c))) == "one two"
    assert decoded(spark, good + "event: error\ndata: x\n\n", lambda c: wire.answer_of(P.sse_parse(c))) is None


def test_responses(spark):
    df = spark.createDataFrame([(200, "text/html; charset=utf-8"), (200, None), (404, "text/html"), (200, "application/pdf")], "status int, content_type string")
    assert tables.html_responses(df).count() == 1


def test_cli(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda master: spark)
    page = "<html><head><title>T</title></head><main><h1>T</h1><p>Words to find.</p></main></html>"
    spark.createDataFrame([("u", page, "s", dt.datetime(2024, 1, 1))], "url string, html string, service_name string, crawled_at timestamp").write.parquet(str(tmp_path / "pages"))
    spark.createDataFrame([("https://docs.aws.amazon.com/IAM/latest/UserGuide/", "a.html")], "page_url string, href string").write.parquet(str(tmp_path / "links"))
    store = ["--store", f"file://{tmp_path}/store"]
    assert cli.main(["init", *store]) == {"version": 1}
    assert cli.main(["ingest", *store, "--pages", str(tmp_path / "pages"), "--max-pages", "5"])["version"] == 2
    assert cli.main(["stats", *store]) == {"totals": {"documents": 1, "chunks": 1}, "services": [{"service_name": "s", "documents": 1, "chunks": 1}]}
    assert cli.main(["crawl", *store, "--links", str(tmp_path / "links"), "--services", "IAM"])["urls"] == 1
    assert cli.main(["health", *store]) == {"session": "ok", "store": "ok"}


def test_decoded_stream_holds_every_document(spark, tmp_path):
    texts = ["a\r\nb\rc\n\nd", "\r", "", "data: x\r\revent: y", "plain", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.data for r in registry.queries()["sse_decode_all"](spark, str(tmp_path)).collect()}
    assert got == {i: t.replace("\r\n", "\n").replace("\r", "\n") for i, t in enumerate(texts) if t is not None}
