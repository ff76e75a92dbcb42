import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from fathom.llm import kernel, lines
from fathom.llm.neardup import NearDuplicates, connected_components, least_matches


def brute(texts, n, threshold, least):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if len(w) >= max(least, n):
            sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = {}
    for base in range(12):
        body = [rng.choice(words) for _ in range(60)]
        for copy in range(5):
            edited = list(body)
            for _ in range(copy):
                edited[rng.randrange(len(edited))] = rng.choice(words)
            texts[base * 10 + copy] = " ".join(edited)
    texts |= {500: None, 501: "", 502: "too short", 503: texts[0].upper().replace(" ", " -- "), 504: texts[0], 505: "日本 " * 20 + "x " * 10}
    return texts


def found(nd):
    return {(r.a, r.b) for r in nd.pairs().collect()}


def test_pairs_and_groups(spark):
    texts = corpus()
    rows = [(i, t) for i, t in texts.items()]
    df = spark.createDataFrame([*rows, rows[0], (None, texts[0])], "chunk_id long, text string").withColumn("class", F.lit("clash"))
    nd = NearDuplicates(df, shingle=3, threshold=0.6, min_words=15)
    want = brute(texts, 3, 0.6, 15)
    assert found(nd) == want and len(want) > 30
    groups = {r.id: r for r in nd.groups().collect()}
    assert set(groups) == {i for i in texts if i not in (500, 501, 502)}
    for a, b in want:
        assert groups[a].group_id == groups[b].group_id
    degree = {i: sum(i in p for p in want) for i in groups}
    assert {i: g.links for i, g in groups.items()} == degree
    assert groups[504].copies == 3 and groups[505].group_size == 1


def test_hot_buckets_are_joined_exactly(spark):
    texts = corpus(2)
    df = spark.createDataFrame(list(texts.items()), "chunk_id long, text string")
    assert found(NearDuplicates(df, shingle=3, threshold=0.6, min_words=15, max_bucket=1)) == brute(texts, 3, 0.6, 15)


def test_crowd_of_copies(spark):
    df = spark.createDataFrame([(i, "one two three four five six") for i in range(8)] + [(9, "one two three four five six seven")], "chunk_id long, text string")
    nd = NearDuplicates(df, shingle=2, threshold=0.8, expand_copies=4)
    assert found(nd) == {(0, i) for i in range(1, 8)} | {(0, 9)}
    groups = {r.id: r for r in nd.groups().collect()}
    assert groups[9].links == 8 and groups[3].links == 8 and groups[3].group_size == 9
    assert groups[3].same_as == 0 and groups[9].same_as == 9  # the head's pairs are those of its copies


def test_variants_in_a_crowd_keep_their_pairs(spark):
    text = "one two three four five six"
    rows = [*((i, text) for i in range(6)), (10, text.upper()), (11, text.replace(" ", ", ")), (12, text.upper()), (20, text + " seven")]
    nd = NearDuplicates(spark.createDataFrame(rows, "chunk_id long, text string"), shingle=2, threshold=0.8, expand_copies=4)
    assert found(nd) == {(0, i) for i in range(1, 6)} | {(a, b) for a in (0, 10, 11, 12, 20) for b in (10, 11, 12, 20) if a < b}
    wide = NearDuplicates(spark.createDataFrame([(i, text.replace(" ", " " + "-" * i + " ")) for i in range(8)], "chunk_id long, text string"), shingle=2, threshold=0.8, expand_copies=4)
    assert found(wide) == {(a, b) for a in range(8) for b in range(8) if a < b}


def test_empty(spark):
    nd = NearDuplicates(spark.createDataFrame([], "chunk_id long, text string"))
    assert nd.pairs().count() == 0 and nd.groups().count() == 0


def test_posterior_bounds():
    bounds = least_matches(0.6, 1e-4, 200, 20)
    assert bounds[0] == (20, 4) or 0 < bounds[0][1] < 12
    assert all(m / n < 0.6 for n, m in bounds) and bounds[-1][1] / 200 > 0.45


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_kernel_hashes_do_not_depend_on_place():
    a = kernel.words(["x alpha beta gamma", "alpha beta gamma"])
    h, first = kernel.shingles(a, 3)
    assert h[1] == h[2] and list(first) == [0, 1, 4]
    assert [a.text[s:e] for s, e in zip(a.start, a.end)] == ["x", "alpha", "beta", "gamma"] + ["alpha", "beta", "gamma"]
    assert list(kernel.words(["a\x00b", None, ""]).doc) == [0, 0]


DOCUMENTS = [(d, "svc" if d < 20 else "other" if d < 40 else None) for d in range(50)]


def test_lines(spark):
    def text(d):
        own = f"Sentence number {d} tells of {'abcdefghij'[d % 10]}{'klmnopqrst'[d // 10]} and more things\n\n"
        return own + ("SHARE THIS PAGE WITH FRIENDS!" if d % 2 else f"Share this page with friends ({d})")

    rows = [(d * 10, d, text(d)) for d, _ in DOCUMENTS] + [(9000, 99, text(1)), (9001, 3, None), (9002, 3, ""), (30, 3, text(3)), (9003, 41, text(1)), (9004, 21, "short one\nshort one")]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string").withColumn("doc", F.lit("clash"))
    documents = spark.createDataFrame(DOCUMENTS, "doc_id long, service_name string").withColumn("text", F.lit("x"))
    got = lines.repeated_lines(chunks, documents)
    exact = {(r.id, r.line_no) for r in got.where("line_documents >= 5").collect()}
    assert exact == {(d * 10, 2) for d in range(40)}
    assert all(r.cluster_documents == 20 and r.line_documents == 20 for r in got.where("line_no = 2").collect())
    clean = {r.chunk_id: r for r in lines.without_repeated(chunks, got.where("line_documents >= 5")).collect()}
    assert clean[0].text == text(0).split("\n")[0] + "\n" and clean[0].lines_removed == 1
    assert clean[9001].text is None and clean[9002].text == "" and clean[410].text == text(41)
    assert lines.repeated_lines(chunks.limit(0), documents).count() == 0


def test_lines_of_near_copies_cluster(spark):
    names = ["Anna", "Bert", "Carl", "Dora", "Emil", "Fred"]
    rows = [(i, i, f"Written on 2024-0{i + 1}-11 by editor {n} for the daily news desk") for i, n in enumerate(names)]
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string")
    documents = spark.createDataFrame([(i, "s") for i in range(6)], "doc_id long, service_name string")
    got = lines.repeated_lines(chunks, documents).collect()
    assert len(got) == 6 and {r.cluster_documents for r in got} == {6} and {r.line_documents for r in got} == {1}
    assert lines.repeated_lines(chunks, documents, min_documents=7).count() == 0


def test_prose_lines_of_one_source_do_not_cluster(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(3, 9))) for _ in range(300)]

    def sentence():
        return " ".join(rng.choice(vocabulary, rng.integers(6, 30))).capitalize() + "."

    templates = [sentence()[:-1] for _ in range(40)]
    rows = []
    for d in range(5000):
        lines_of = [sentence()]
        if d < 240:  # each template in six documents, each time with another name and date
            lines_of.append(f"{templates[d % 40]} by {str(rng.choice(vocabulary)).capitalize()} on 2024-01-{d % 28 + 1}")
        rows.append((d, d, "\n".join(lines_of)))
    chunks = spark.createDataFrame(rows, "chunk_id long, document_id long, text string")
    documents = spark.createDataFrame([(d, "s") for d in range(5000)], "doc_id long, service_name string")
    got = {(r.id, r.line_no) for r in lines.repeated_lines(chunks, documents).collect()}
    planted = {(d, 1) for d in range(240)}
    assert len(got & planted) >= 0.95 * len(planted) and len(got - planted) <= 0.05 * len(got)


def test_star_clusters_do_not_chain(spark):
    """A line like its neighbour but not like the leader does not follow the neighbour; a mixed bucket takes several rounds."""
    def grams(at):  # steps of 4 of 44 words: 0.83 from step to step, 0.69 over two
        return list(range(at * 4, at * 4 + 44))

    rows = [(1, 100, grams(0), [7]), (2, 50, grams(1), [7]), (3, 10, grams(2), [7]), (4, 5, grams(3), [7]), (5, 1, list(range(900, 940)), [7])]
    nodes = spark.createDataFrame(rows, "node long, rank long, grams array<int>, bands array<long>")
    for paired in (64, 3):  # all pairs verified, or a leader first, as the bucket is too full
        assert {r.node: r.cluster for r in lines.star_clusters(nodes, 0.8, paired).collect()} == {2: 1, 4: 3}, paired
    cut = {r.node: r.cluster for r in lines.star_clusters(nodes, 0.8, 1).collect()}  # cut as well: may part 3 and 4
    assert cut in ({2: 1}, {2: 1, 4: 3})
    assert lines.star_clusters(nodes.limit(0), 0.8).count() == 0


def test_many_variants_join_one_leader(spark):
    """A bucket too full to be paired off, with most of its lines like the most frequent one."""
    rows = [(i, 1000 - i, [*range(50), 1000 + i], [1, 50 + i % 7]) for i in range(300)] + [(900 + i, 1, list(range(2000 + 60 * i, 2050 + 60 * i)), [1]) for i in range(5)]
    nodes = spark.createDataFrame(rows, "node long, rank long, grams array<int>, bands array<long>")
    assert {r.node: r.cluster for r in lines.star_clusters(nodes, 0.8).collect()} == {i: 0 for i in range(1, 300)}
    unlike = spark.createDataFrame([(i, i, list(range(100 * i, 100 * i + 20)), [1]) for i in range(3000)], nodes.schema)
    assert lines.star_clusters(unlike, 0.8, 20).count() == 0  # ends soon, though none joins any


def _stars(rows, similar):
    """Brute force over all pairs that share a bucket."""
    order = sorted(rows, key=lambda r: (-r[1], -r[0]))
    like = lambda a, b: len(set(a[2]) & set(b[2])) / len(set(a[2]) | set(b[2]))
    lead, joined = [], {}
    for r in order:
        near = [(like(r, x), x[0]) for x in lead if set(r[3]) & set(x[3]) and like(r, x) >= similar]
        if near:
            joined[r[0]] = max(near)[1]
        else:
            lead.append(r)
    return joined


def test_full_buckets_lose_no_pair(spark):
    """200 pairs of similar lines in one bucket, each unlike all others and unlike the most frequent line."""
    rows = [(0, 9999, list(range(40)), [1])]
    for i in range(200):
        own = [1000 + 40 * i + j for j in range(40)]
        rows += [(1 + 2 * i, 500 + i, own, [1]), (2 + 2 * i, i, [*own[:36], *(100_000 + 4 * i + j for j in range(4))], [1])]
    rows += [(5000, 10_001, list(range(-100, -65)), [2]), (5001, 10_000, list(range(-100, -72)), [2])]  # 28 of 35: 0.8
    nodes = spark.createDataFrame(rows, "node long, rank long, grams array<int>, bands array<long>")
    want = {2 + 2 * i: 1 + 2 * i for i in range(200)} | {5001: 5000}
    assert _stars(rows, 0.8) == want
    for paired in (4, 1000):
        assert {r.node: r.cluster for r in lines.star_clusters(nodes, 0.8, paired).collect()} == want, paired


def test_stars_do_not_depend_on_how_buckets_are_paired(spark):
    """Variants of a few lines over several buckets: leaders of other buckets, later rounds and all pairs come to the same."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        base, drift = int(rng.integers(0, 5)), int(rng.integers(0, 14))
        own = [100 * base + drift + j for j in range(30)]
        rows.append((i, int(rng.integers(0, 60)), [*own, *(int(x) for x in rng.integers(5000, 5040, rng.integers(0, 3)))], sorted({int(x) for x in rng.integers(0, 4, 2)} | {10 + base})))
    rows = [(n, r, sorted(set(g)), b) for n, r, g, b in rows]
    nodes = spark.createDataFrame(rows, "node long, rank long, grams array<int>, bands array<long>")
    want = _stars(rows, 0.8)
    assert len(want) > 150
    for paired in (3, 40, 1000):
        assert {r.node: r.cluster for r in lines.star_clusters(nodes, 0.8, paired).collect()} == want, paired
