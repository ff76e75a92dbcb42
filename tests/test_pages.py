import http.server
import threading
import time

from fathom.operators.chunking import chunk_nodes, chunk_pages, context, count, exploded, prose, run_statistics, table, tail
from fathom.sources import fetch
from fathom.sources.html import flatten_html, flatten_page

PAGE = """<html><head><title>Rotate keys - Amazon Key Service</title></head><body><nav><p>menu</p></nav>
<main role="main"><div class="awsdocs-breadcrumb">here</div><h1>Rotate keys</h1><p>Intro with <b>bold</b> word.
<h2>Policies</h2><p>Attach this policy.<pre class="programlisting"><code>{"Effect": "Allow"}</code></pre>
<h3>Details</h3><table><tr><th>a<th>b<tr><td>1|2<td>3</table>
<div class="awsdocs-note"><p class="title">Warning</p><p>Take care</div>
<h2>Steps</h2><ol><li>first<ul><li>inner</ul><li>second</ol>loose text</main><footer>foot</footer></body></html>"""


def kinds(nodes):
    return [(n[3], n[4]) for n in nodes]


def test_flatten():
    ok, error, title, nodes = flatten_page(PAGE)
    assert ok and error is None and title == "Rotate keys"
    assert kinds(nodes) == [
        ("paragraph", "Intro with bold word."),
        ("section", "Policies"),
        ("paragraph", "Attach this policy."),
        ("code", '{"Effect": "Allow"}'),
        ("section", "Details"),
        ("table", "| a | b |\n| --- | --- |\n| 1\\|2 | 3 |"),
        ("admonition", "Take care"),
        ("section", "Steps"),
        ("list", "1. first\n  - inner\n2. second"),
        ("paragraph", "loose text"),
    ]
    assert [h[0] for h in nodes[5][8]] == ["Rotate keys", "Policies", "Details"]
    assert [h[0] for h in nodes[8][8]] == ["Rotate keys", "Steps"]
    assert nodes[3][6] == "json" and nodes[6][7] == "Warning"


def test_inline_separator():
    assert flatten_page("<main><p>a<b>b</b></main>", "")[3][0][4] == "ab"


def test_dirty_pages():
    assert flatten_page(None) == (True, None, "", [])
    assert flatten_page("")[3] == []
    assert kinds(flatten_page("<p>cut <b>of")[3]) == [("paragraph", "cut of")]
    assert kinds(flatten_page("<main><h2></h2><blockquote>no</blockquote></main>")[3]) == []


def test_chunks():
    _, _, title, nodes = flatten_page(PAGE)
    chunks = chunk_nodes(title, nodes)
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert [c[2] for c in chunks] == ["prose", "prose", "config", "table", "prose", "prose", "prose"]
    assert chunks[2][1].startswith("Context: Attach this policy.\n[Rotate keys > Policies] ```json\n")
    assert chunks[4][1] == "[Rotate keys > Policies > Details] Warning: Take care"
    assert chunks[6][1] == "[Rotate keys > Steps] ...1. first\n  - inner\n2. second... loose text"
    assert all(c[4] == count(c[1]) > 0 for c in chunks)


def test_prose_packing():
    sentence = "This is a sentence of nine words right here."
    bodies = prose(" ".join([sentence] * 50), "Path", 50)
    assert len(bodies) > 1 and all(count(b) <= 50 for b in bodies) and " ".join(bodies) == " ".join([sentence] * 50)
    assert prose("one\n\ntwo", "", 50) == ["one\n\ntwo"]
    assert prose("word " * 100, "", 20) == [("word " * 100).strip()]
    assert prose("  ", "") == []


def test_table_packing():
    text = "\n".join(["| h |", "| --- |", *(f"| row {i} |" for i in range(100))])
    bodies = table(text, "P", 50)
    assert len(bodies) > 1 and all(b.startswith("| h |\n| --- |\n") for b in bodies)
    assert [r for b in bodies for r in b.split("\n")[2:]] == text.split("\n")[2:]
    assert table("| a |", "") == ["| a |"]


def test_overlap_rules():
    nodes = [(0, 1, -1, "paragraph", "alpha beta gamma", None, None, None, [("A", 0)]), (1, 1, -1, "paragraph", "delta", None, None, None, [("A", 0)]), (2, 1, -1, "paragraph", "epsilon", None, None, None, [("B", 0)])]
    texts = [c[1] for c in chunk_nodes("", nodes, overlap=2)]
    assert texts == ["[A] alpha beta gamma", "[A] ...beta gamma... delta", "[B] epsilon"]
    assert [c[1] for c in chunk_nodes("", nodes, overlap=0)][1] == "[A] delta"


def test_context_and_tail():
    assert context("a. " * 10 + "Last sentence.", 5) == "Last sentence."
    assert count(context("word " * 200, 100)) == 100
    assert tail("a b c", 2) == "b c" and tail("a", 5) == "a"


def test_plans(spark):
    df = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "crawl_id long, html string")
    assert flatten_html(df).selectExpr("sum(size(nodes))").first()[0] == 10
    chunked = chunk_pages(df)
    assert exploded(chunked, "crawl_id").count() == 7
    assert tuple(run_statistics(chunked).first()) == (1, 2, 0, 7)
    assert chunk_pages(df.limit(0)).count() == 0


def test_fetch_keeps_to_its_rate(spark):
    class Site:
        def get(self, url):
            if "bad" in url:
                raise OSError("unreachable")
            return 200, "text/html", f"<main><p>{url}</main>"

    urls = spark.createDataFrame([(f"https://h/{i}",) for i in range(6)] + [("https://bad/1",), ("https://h/1",), (None,)], "url string")
    began = time.monotonic()
    got = {r.url: (r.status, r.error) for r in fetch.fetch(urls.coalesce(1), Site, rate=5.0, burst=2).collect()}
    assert time.monotonic() - began >= 4 / 5.0
    assert got == {f"https://h/{i}": (200, None) for i in range(6)} | {"https://bad/1": (None, "OSError: unreachable")}
    assert fetch.fetch(urls.limit(0), Site).count() == 0


def test_url_fetcher():
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            self.wfile.write("<p>é</p>".encode("latin-1"))

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base = f"http://127.0.0.1:{server.server_port}"
        assert fetch.UrlFetcher(5).get(base + "/ok") == (200, "text/html; charset=latin-1", "<p>é</p>")
        assert fetch.UrlFetcher(5).get(base + "/no")[0] == 404
    finally:
        server.shutdown()


def test_own_parser(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, None)], "crawl_id long, html string")
    lines = lambda html, sep: (True, None, "T", [(i, 1, -1, "paragraph", x, None, None, None, [("T", 0)]) for i, x in enumerate((html or "").split("\n")) if x])
    got = exploded(chunk_pages(df, parser=lines, overlap=0), "crawl_id").orderBy("chunk_index").collect()
    assert [r.text for r in got] == ["[T] a", "[T] b"]
