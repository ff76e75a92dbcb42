import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathom.llm import boilerplate, knn, leak, quality


def vectors(n=600, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, 16))
    return np.concatenate([base, base + rng.normal(size=base.shape) * 0.2, base + rng.normal(size=base.shape) * 0.3]).astype(np.float32)


def nearest(x, k, least=-1.0):
    x = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    order = np.argsort(-s, 1, kind="stable")[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in order[i] if s[i, j] >= least}


@pytest.fixture
def small_lists(monkeypatch):
    monkeypatch.setattr(knn, "LIST_ROWS", 60)
    monkeypatch.setattr(knn, "WORDS", 32)


def frame(spark, x, extra=()):
    return spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), *extra], "chunk_id long, embedding array<float>").withColumn("id", F.lit("clash"))


def test_similar(spark, small_lists, monkeypatch):
    x = vectors()
    x[5] *= 1000  # length plays no role
    bad = [(9000, None), (9001, [1.0]), (9002, [0.0] * 16), (9003, [float("nan")] * 16), (9004, [None] * 16), (None, x[0].tolist())]
    index = knn.VectorIndex(frame(spark, x, bad), dim=16)
    want = nearest(x, 5, 0.9)
    got = {(r.id, r.neighbour) for r in index.similar(5, 0.9).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(knn, "BLOCK_QUERIES", 50)
    assert {(r.id, r.neighbour) for r in index.similar(5, 0.9).collect()} == got
    asked = index.all.where("id % 20 = 0").select("id", "vector")
    all_five = nearest(x, 5)
    found = {(r.id, r.neighbour) for r in index.search(asked, 5).collect()}
    wanted = {p for p in all_five if p[0] % 20 == 0}
    assert len(found & wanted) >= 0.9 * len(wanted)


def test_copies(spark, small_lists):
    x = vectors(60)
    copies = [(100 + i, x[0].tolist()) for i in range(9)]
    index = knn.VectorIndex(frame(spark, x, [*copies, copies[0]]), dim=16)
    got = {}
    for r in index.similar(3, 0.9).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    assert sorted(got[0]) == [(1, 100), (2, 101), (3, 102)]
    assert sorted(got[108]) == [(1, 0), (2, 100), (3, 101)]
    assert all(a < b for a, b in ((r.a, r.b) for r in knn.linked_pairs(index.similar(3, 0.9)).collect()))


def test_search_finds_the_copies_of_a_head(spark, small_lists):
    x = vectors(60)
    index = knn.VectorIndex(frame(spark, x, [(100 + i, x[0].tolist()) for i in range(9)]), dim=16)
    got = {}
    for r in index.search(index.all.where("id IN (0, 1, 108)").select("id", "vector"), 3).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    assert sorted(got[0]) == [(1, 100), (2, 101), (3, 102)]
    assert sorted(got[108]) == [(1, 0), (2, 100), (3, 101)]
    assert len(got[1]) == 3 and 1 not in {n for _, n in got[1]}


def test_many_vectors_keep_one_level_of_lists(spark, monkeypatch):
    for name, value in (("LIST_ROWS", 2), ("MAX_LISTS", 8), ("WORDS", 32)):
        monkeypatch.setattr(knn, name, value)
    x = vectors()  # far more than the lists hold at LIST_ROWS
    index = knn.VectorIndex(frame(spark, x), dim=16)
    assert index._stored(True).select("cell").distinct().count() <= 8
    want = nearest(x, 5)
    got = {(r.id, r.neighbour) for r in index.similar(5).collect()}
    assert len(got & want) >= 0.97 * len(want)


def test_no_vectors(spark):
    index = knn.VectorIndex(frame(spark, np.zeros((0, 16), np.float32)), dim=16)
    assert index.similar().count() == 0 and index.search(index.all.select("id", "vector")).count() == 0


def test_beam_beats_greedy():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8)).astype(np.float32)
    books = [rng.normal(size=(16, 8)).astype(np.float32) * s for s in (1, 0.6, 0.4)]
    greedy, beam = ((knn.beam_encode(x, books, b)[1][:, 0] ** 2).sum() for b in (1, 8))
    assert beam < greedy
    codes, left = knn.beam_encode(x, books, 4)
    assert np.allclose(sum(b[c] for b, c in zip(books, codes[:, 0].T)) + left[:, 0], x, atol=1e-5)


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then runs far away home"), (2, "short item here"), (3, None), (4, " . "), (5, "the quick brown fox jumps over the lazy dog and then runs"), (6, "one"), (7, "short item here")]
DOCS = [
    (1, "Start: The QUICK, brown **fox** jumps\nover the lazy dog and then runs off"),
    (2, "quick brown fox jumps over the lazy dog and then"),
    (3, "a short -- item; here"),
    (4, None),
    (5, ""),
    (6, "one " * 3),
    (7, "short item there"),
    (3, "a short -- item; here"),
    (8, "the quick brown fox jumps over the lazy cat and then runs far away home the lazy dog and then runs"),
    (9, "x " * 20000 + "short item here"),
]


def brute_leaks():
    out = set()
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    for d, t in DOCS:
        text = " " + " ".join(words(t)) + " "
        for i, passage in ITEMS:
            w = words(passage)
            n = min(12, len(w))
            if w and any(" " + " ".join(w[s : s + n]) + " " in text for s in range(len(w) - n + 1)):
                out.add((d, i))
    return out


@pytest.mark.parametrize(("shingles", "windows"), [(1 << 20, 1000), (0, 0)])
def test_leaks(spark, shingles, windows):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("pos", F.lit("clash"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = leak.leaked_windows(docs, items, broadcast_shingles=shingles, broadcast_windows=windows)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == brute_leaks()
    report = {(r.doc_id, r.item_id): r for r in leak.leaked_items(got).collect()}
    assert report[1, 5].covered == 1.0 and report[1, 1].covered == pytest.approx(12 / 15)
    assert leak.leaked_windows(docs.limit(0), items).count() == 0 and leak.leaked_windows(docs, items.limit(0)).count() == 0


PROSE = "The old gate of the town was closed in the night, and no one could say when it would be opened again. It is not known if the guard had lost the key or if he had left it with a friend. "
TABLE = "| a17 | 22 | 9.5 |\n| --- | --- | --- |\n" + "\n".join(f"| x{i} | {i * 7} | {i}.5 |" for i in range(25))
WRAPPED = "\n".join(re.findall(r".{1,40}(?:\s|$)", PROSE * 2))
QUALITY = [(1, PROSE * 3), (2, TABLE), (3, None), (4, ""), (5, " \n\t"), (6, WRAPPED), (7, "Loading page\n" * 30), (8, "bucket key role zone table lease queue " * 20), (9, PROSE + "\n\n" + TABLE * 3), (10, PROSE * 4 + "\n\n" + TABLE), (1, PROSE * 3), (11, '{"a1": "b2", "c3": [1, 2]}' * 20)]
COMMON = [("en", w) for w in "the of in and no it is not if or was had be when a with he as to".split()] + [("en", None), ("xx", " ")]


def test_quality(spark):
    docs = spark.createDataFrame(QUALITY * 4, "doc_id long, text string").withColumn("word", F.lit("clash"))
    common = spark.createDataFrame(COMMON, "lang string, word string")
    got = {r.doc_id: r for r in quality.rate_documents(docs, common).collect()}
    kinds = {i: r.text_type for i, r in got.items()}
    assert kinds == {1: "prose", 2: "other", 3: "empty", 4: "empty", 5: "empty", 6: "prose", 7: "other", 8: "other", 9: "other", 10: "prose", 11: "other"}
    words = re.findall(r"[^\W_]+", PROSE.lower())
    one = got[1]
    assert one.word_count == 3 * len(words) and one.mean_word_length == pytest.approx(sum(map(len, words)) / len(words))
    assert one.common_word_share == pytest.approx(sum(w in {c for _, c in COMMON} for w in words) / len(words))
    solid = re.sub(r"\s", "", PROSE)
    assert one.symbol_ratio == pytest.approx(sum(not c.isalnum() for c in solid) / len(solid)) and one.punct_line_share == 1
    assert got[3].word_count == 0 and got[3].mean_word_length is None and got[5].prose_share is None
    assert quality.rate_documents(docs.limit(0), common).count() == 0
    assert quality.rate_documents(docs.limit(1), common.limit(0)).count() == 1


def test_em_finds_the_good_votes():
    rng = np.random.default_rng(1)
    k, n = len(quality.VOTES), 20000
    prose, right = rng.random(n) < 0.7, np.array([0.95, 0.9, 0.9, 0.85, 0.6, 0.8, 0.55, 0.8, 0.75])
    votes = np.where(rng.random((n, k)) < right, np.where(prose, 2, 1)[:, None], np.where(prose, 1, 2)[:, None])
    votes[rng.random((n, k)) < 0.1] = 0
    pattern = votes @ (3 ** np.arange(k - 1, -1, -1))
    known, inverse, counts = np.unique(pattern, return_inverse=True, return_counts=True)
    theta, prior, post = quality.learn(known, counts.astype(float))
    assert abs(prior - 0.7) < 0.03 and ((post[inverse] > 0.5) == prose).mean() > 0.95
    assert abs(theta[1, 0, 2] / (theta[1, 0, 1] + theta[1, 0, 2]) - 0.95) < 0.02


def page(i, named):
    main, side = ('main id="main-content"', 'aside class="sidebar"') if named else (f'div class="k{i}"', f'div class="q{i}"')
    end, side_end = ("main", "aside") if named else ("div", "div")
    return f"""<html><head><title>T{i}<p></title><script>var a = "<li>no</li>";</script></head><body><nav class="n"><ul><li><a href="/">Home {i}</a><li><a href="/p">Pricing</a></ul></nav>
<{main}><h1>Topic {i}</h1><p>The worker of queue {i} is started when the lease ends, and it holds all keys.<table><tr><th>name<th>size</tr><tr><td>k{i}<td>&nbsp;</tr></table>
<!-- <p>hidden</p> --><P>You can move the shard to another zone before the limit is reached.</P><pre>run {i}</pre></{end}>
<{side}><h2>Related</h2><ul><li><a href="/x">How to move {i}</a></li></ul><p>Share on Net{i}</p></{side_end}><footer><p>Contact sales of Firm{i}</p><li>Site map</footer></body></html>"""


def test_main_blocks(spark):
    rows = [(i, page(i, i % 2 == 0)) for i in range(120)] + [(1000, None), (1001, ""), (1002, "<p"), (1003, page(3, False)), (1004, page(4, True)[:700]), (1005, "<main><p>Page moved.</p></main>")]
    df = spark.createDataFrame(rows, "crawl_id long, html string").withColumn("id", F.lit("clash"))
    got = {}
    for r in boilerplate.main_blocks(df).collect():
        got.setdefault(r.crawl_id, {})[r.block_no] = r.tag
    article = {2: "h1", 3: "p", 4: "th", 5: "th", 6: "td", 8: "p", 9: "pre"}
    right = sum(got.get(i) == article for i in range(120))
    assert right >= 114, {i: got.get(i) for i in range(4)}
    assert got[1003] == got[3] and not {1000, 1001, 1002, 1005} & set(got)
    assert boilerplate.main_blocks(df.limit(0)).count() == 0


def test_long_pages_are_learned_from_whole(spark):
    """The main part begins after a long script in the head."""
    late = lambda i, named: page(i, named).replace("<script>", "<script>" + "var b = 1;\n" * 2500)
    rows = [(i, late(i, i % 2 == 0)) for i in range(60)]
    df = spark.createDataFrame(rows, "crawl_id long, html string")
    whole = {h for i, h in rows if i % 2 == 0}
    assert set(boilerplate.training_pages(df, "html")) == whole
    got = {}
    for r in boilerplate.main_blocks(df).collect():
        got.setdefault(r.crawl_id, {})[r.block_no] = r.tag
    assert sum(got.get(i) == {2: "h1", 3: "p", 4: "th", 5: "th", 6: "td", 8: "p", 9: "pre"} for i in range(60)) >= 57
    some = boilerplate.training_pages(df, "html", chars=100_000)
    assert len(some) == 3 and set(some) < whole
    assert len(boilerplate.training_pages(df, "html", chars=10)) == 1


def test_messages_equal_brute_force():
    """Marginals on a small tree against the sum over all labellings."""
    f = boilerplate.Forest()
    f.scan("<div><p>a</p><ul><li>b</li><li>c</li></ul></div>")
    x = boilerplate.Features(f, True)
    n = len(f.parent)
    rng = np.random.default_rng(4)
    score, pair = rng.normal(size=n), rng.normal(size=(boilerplate.KINDS, boilerplate.KINDS, 2, 2))
    total, one = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [code >> i & 1 for i in range(n)]
        weight = np.exp(sum(score[i] * y[i] for i in range(n)) + sum(pair[x.plain[x.parent[i]], x.plain[i], y[x.parent[i]], y[i]] for i in range(1, n)))
        total += weight
        one += weight * np.array(y)
    assert np.allclose(boilerplate.marginals(x, score, pair), one / total)


def test_similar_finds_far_neighbours_too(spark, monkeypatch):
    """Without a threshold nine in ten of all true neighbours are found, with many lists as well."""
    monkeypatch.setattr(knn, "WORDS", 64)
    x = np.random.default_rng(11).normal(size=(4000, 24)).astype(np.float32)
    want = nearest(x, 5)
    for list_rows in (400, 60):
        index = knn.VectorIndex(frame(spark, x), dim=24, list_rows=list_rows)
        got = {(r.id, r.neighbour) for r in index.similar(5).collect()}
        assert len(got & want) >= 0.9 * len(want), (list_rows, len(got & want) / len(want))
    assert [knn.probes_for(n) for n in (1, 28, 277, 4096)] == sorted(knn.probes_for(n) for n in (1, 28, 277, 4096))


def test_many_common_words_are_joined(spark):
    """Beyond the broadcast bound the statistics are the same, repeated and empty texts included."""
    docs = spark.createDataFrame(QUALITY * 2, "doc_id long, text string")
    common = spark.createDataFrame(COMMON, "lang string, word string")
    few, many = ([tuple(r) for r in quality.rate_documents(docs, common, broadcast_words=n).orderBy("doc_id").collect()] for n in (100_000, 0))
    assert few == many


def test_deeply_nested_page():
    """Elements that are never closed cost no more than their number."""
    f = boilerplate.Forest()
    f.scan("<ul><li>" * 20_000 + "<p>end</p>" + "</span></ul>" * 10)
    x = boilerplate.Features(f, True)
    assert max(f.depth) == len(x.levels) and sum(map(len, x.levels)) == len(f.parent) - 1
    assert all((x.depth[level] == d + 1).all() for d, level in enumerate(x.levels))
    assert x.leaf.sum() == 1 and len(boilerplate.marginals(x, np.zeros(len(f.parent)), np.zeros((boilerplate.KINDS, boilerplate.KINDS, 2, 2)))) == len(f.parent)


def test_groups_of_lists(spark, monkeypatch):
    """Where there are more lists than are all compared, groups of them lead to the same neighbours."""
    for name, value in (("WORDS", 64), ("FLAT_LISTS", 20), ("LEAST_GROUPS", 4)):
        monkeypatch.setattr(knn, name, value)
    x = np.random.default_rng(12).normal(size=(4000, 24)).astype(np.float32)
    index = knn.VectorIndex(frame(spark, x), dim=24, list_rows=60)
    assert index.books.groups is not None and 40 <= len(index.books.books[0]) <= 80
    cells = index.books.cells(x, index.probes)
    assert all(len(set(row)) == index.probes for row in cells.tolist())
    assert index.books.cells(x[:5], 500).shape == (5, len(index.books.books[0]))
    want = nearest(x, 5)
    got = {(r.id, r.neighbour) for r in index.similar(5).collect()}
    assert len(got & want) >= 0.9 * len(want)
