import pytest
from pyspark.sql import functions as F

from fathom.functions import presentation as P
from fathom.functions import text as X
from fathom.functions import urls as U
from fathom.functions.stem import stem


def values(spark, rows, column):
    df = spark.createDataFrame([(r,) for r in rows], "x string")
    return [r.v for r in df.select(column(F.col("x")).alias("v")).collect()]


def test_tokens(spark):
    assert values(spark, ["a b-c", "", None, "x y", "日本。"], X.token_count) == [4, 0, 0, 2, 2]


def test_head_and_tail(spark):
    assert values(spark, ["one two-three four", "a", ""], lambda c: X.head_tokens(c, 3)) == ["one two-", "a", ""]
    assert values(spark, ["one two-three four", "a", ""], lambda c: X.tail_tokens(c, 3)) == ["-three four", "a", ""]


def test_sentences(spark):
    assert values(spark, ["One. Two! three. Four"], X.sentences) == [["One.", "Two! three.", "Four"]]
    assert values(spark, ["One. two"], X.last_sentence) == ["two"]


@pytest.mark.parametrize(("text", "config"), [('{"Effect": "Allow"}', True), ("AWSTemplateFormatVersion", False), ('"AWSTemplateFormatVersion": 1', True), ('resource "aws_s3_bucket" "b" {}', True), ("def f(): pass", False)])
def test_config(spark, text, config):
    assert values(spark, [text], X.is_config) == [config]


def test_preview_counts_code_points(spark):
    assert values(spark, ["Hello, World!"], lambda c: X.preview(c, 5)) == ["Hello..."]
    assert values(spark, ["日本語テスト", "🎉🎉"], lambda c: X.preview(c, 3)) == ["日本語...", "🎉🎉"]


def test_header(spark):
    df = spark.createDataFrame([("[A > B] text",), ("[open",), ("plain",)], "x string")
    header, body = X.split_header(F.col("x"))
    assert [tuple(r) for r in df.select(header, body).collect()] == [("[A > B] ", "text"), ("", "[open"), ("", "plain")]


def test_context_line(spark):
    long = "First part here. " + "word " * 60 + "end. Last one"
    assert values(spark, ["Short one.", long], lambda c: X.context_line(c, 20)) == ["Short one.", "Last one"]


def test_normalize(spark):
    rows = ["https://h/a/#x", "https://h/", "https://h/a//", "https://h/a?q=1#z", "#top"]
    assert values(spark, rows, U.normalize) == ["https://h/a", "https://h/", "https://h/a", "https://h/a?q=1", ""]


def test_scope_prefix(spark):
    rows = ["https://h/s/latest/dg/welcome.html", "https://h/s/latest/dg/", "https://h/s?q=a.b", "https://h/"]
    assert values(spark, rows, U.scope_prefix) == ["https://h/s/latest/dg", "https://h/s/latest/dg", "https://h/s", "https://h/"]


def test_service(spark):
    rows = ["https://docs.aws.amazon.com/AmazonS3/latest/", "https://docs.aws.amazon.com/AWSEC2/x/", "https://docs.aws.amazon.com/glue/x/", "https://else.example/"]
    assert values(spark, rows, U.service_of) == ["s3", "ec2", "glue", "unknown"]


def test_skip(spark):
    rows = ["https://h/pricing/", "https://h/a.PDF", "https://h/api-ref/x", "https://h/release-notes/", "https://h/dg/a.html"]
    assert values(spark, rows, U.skipped) == [True, True, True, True, False]


def test_resolve(spark):
    df = spark.createDataFrame([("https://h/a/b.html", "../c.html"), ("https://h/a/b.html", None), (None, "x"), ("https://h/", "https://[bad")], "p string, h string")
    assert [r.v for r in df.select(U.resolve("p", "h").alias("v")).collect()] == ["https://h/c.html", None, None, None]


def test_hrefs(spark):
    assert values(spark, ['<a href="x">1</a><A class="k" HREF="y">2</A><area href="z">'], U.hrefs) == [["x", "y"]]


def test_stems():
    pairs = {"running": "run", "flies": "fli", "consistency": "consist", "relational": "relat", "hopping": "hop", "caresses": "caress", "skies": "sky", "generously": "generous", "news": "news", "hoped": "hope", "controlling": "control"}
    assert {w: stem(w) for w in pairs} == pairs


def test_cache_key(spark):
    df = spark.createDataFrame([("Query", 5, ["b", "a"]), ("query", 5, ["a", "b"]), ("query", 6, ["a", "b"])], "q string, k int, s array<string>")
    a, b, c = (r.v for r in df.select(P.cache_key(F.col("q"), F.col("k"), F.col("s")).alias("v")).collect())
    assert a == b != c


def test_relative_time(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-01 11:58:30",), ("2023-12-30 12:00:00",), (None,)], "t string")
    value, unit = P.relative_time(F.col("t").cast("timestamp"), F.lit("2024-01-01 12:00:00").cast("timestamp"))
    assert [tuple(r) for r in df.select(value, unit).collect()] == [(-12, "hour"), (-1, "minute"), (-2, "day"), (None, "unknown")]


def test_requests(spark):
    df = spark.createDataFrame([("q", None), (" ", 5), ("q", 21), (None, 1), ("q", 1)], "q string, k int")
    assert [r.v is None for r in df.select(P.validate(F.col("q"), F.col("k")).alias("v")).collect()] == [True, False, False, False, True]
    assert values(spark, [" a, b ,,", " , "], P.parse_services) == [["a", "b"], None]


def test_events_round_trip(spark):
    df = spark.createDataFrame([("one\ntwo\n\n three",), ("",)], "x string")
    stream = F.concat(F.lit(": ping\n"), P.sse_event(F.lit("chunk"), F.col("x")), P.sse_event(F.lit("done"), F.lit(None).cast("string")))
    got = [[tuple(e) for e in r.v] for r in df.select(P.sse_parse(stream).alias("v")).collect()]
    assert got == [[("chunk", "one\ntwo\n\n three"), ("done", "")], [("chunk", ""), ("done", "")]]
