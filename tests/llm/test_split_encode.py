import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathom.llm import encode, split

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")


def whole(pieces, text):
    """The text that the own parts of the pieces make up."""
    return "".join(t[: b[3] - a[3]] if i == 0 else t[len(t) - (b[3] - a[3]) :] for i, ((t, *_), a, b) in enumerate(zip(pieces, pieces, [*pieces[1:], (None, 0, 0, len(text))])))


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from("ab .\n!_ 日。-"), max_size=400), st.integers(5, 40), st.integers(0, 4))
def test_split_keeps_all(text, limit, overlap):
    pieces = split.split_text(text, limit, overlap)
    n = len(TOKEN.findall(text))
    assert bool(pieces) == (n > limit)
    if pieces:
        assert whole(pieces, text) == text
        assert all(p[1] <= limit and len(TOKEN.findall(p[0])) == p[1] for p in pieces)
        assert pieces[0][2] == 0 and all(p[2] == overlap for p in pieces[1:])
        for a, b in zip(pieces, pieces[1:]):
            assert TOKEN.findall(a[0])[len(TOKEN.findall(a[0])) - overlap :] == TOKEN.findall(b[0])[:overlap]


def test_boundaries_are_natural():
    text = "\n\n".join(" ".join(f"Word{i} number {k} stands here." for k in range(12)) for i in range(12))
    pieces = split.split_text(text, 120, 10)
    assert len(pieces) == -(-(len(TOKEN.findall(text)) - 10) // 110) or len(pieces) > 1
    assert all(p[0].rstrip().endswith(".") for p in pieces)


def test_one_endless_line():
    pieces = split.split_text("x-" * 2000, 512, 50)
    assert max(p[1] for p in pieces) <= 512 and whole(pieces, "x-" * 2000) == "x-" * 2000
    assert split.split_text("x" * 100_000) == []  # one word is one token


def test_split_rows(spark):
    long = "word " * 1200
    rows = [(1, long, "A > B", 7), (1, long, None, 7), (2, None, "x", 0), (3, "", "x", 0), (4, "short", "x", 0), (None, long, "", 0)]
    df = spark.createDataFrame(rows, "chunk_id long, text string, section_path string, id int").withColumn("path", F.lit("clash"))
    got = split.split_oversized(df).collect()
    assert {(r.chunk_id, r.section_path) for r in got} == {(1, "A > B"), (1, None), (None, "")}
    assert all(r.piece_count == 3 and r.token_count <= 512 for r in got) and len(got) == 9
    assert split.split_oversized(df.limit(0)).count() == 0


def test_transducer_round_trip(tmp_path):
    entries = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["walk", "walking", "talk", "talking", "a", "ab", "ö", "walks"])}
    t = encode.Transducer.build(entries)
    (tmp_path / "f").write_bytes(t.dump())
    for x in (t, encode.Transducer.map(str(tmp_path / "f"))):
        places = x.places([*entries, b"", b"wal", b"walkings", b"zzz", b"\xff"])
        assert [x.output(p) for p in places[: len(entries)].tolist()] == list(entries.values())
        assert (places[len(entries) :] == -1).all()
    shared = len(encode.Transducer.build({b"walking": [1], b"talking": [2]}).final)
    assert shared == 8  # the suffix is stored once
    assert encode.Transducer.build({}).places([b"a"]).tolist() == [-1]


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    try:
        return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=encode.load_ranks(VOCABULARY), special_tokens={})
    except FileNotFoundError:
        pytest.skip("no vocabulary file")


ODD = ["", " ", "\n\n \t x", "a b　c\x1cd\x85e", "don't 'LL we'll", "<|endoftext|>", "naïve café ½ ﬁ 𝔘𝔫 한국어 שלום 日本語 🎉🎉", "x" * 5000, "   trailing   ", "​﻿", "1234567890 " * 50, "a\r\nb\r\rc"]


def test_encode_equals_library(spark, reference):
    rows = [(i, t) for i, t in enumerate([*ODD, None, "same words here", "same words here"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df.drop("ids"), VOCABULARY, PATTERN, lexicon_size=4).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in rows}
    assert encode.encode_corpus(df.limit(0), VOCABULARY, PATTERN).count() == 0
    lists = spark.createDataFrame([*got.items(), (-1, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in encode.decode_corpus(lists, VOCABULARY).collect()} == {i: t or "" for i, t in rows} | {-1: None}


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_merge_equals_library(reference, text):
    ranks = encode.load_ranks(VOCABULARY)
    assert [i for w in encode.word_pattern(PATTERN).findall(text) for i in encode.merge_exact(w.encode(), ranks)] == reference.encode_ordinary(text)


def test_frequent_words_are_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([1, 1, 2, 3, 9, 9, 500])], "word string, n long")
    assert set(encode.frequent_words(counts, 3)) == {"w4", "w5", "w6"}
    assert set(encode.frequent_words(counts, 2)) == {"w6"}
    assert encode.frequent_words(counts.limit(0), 5) == []


PARTS = st.one_of(st.sampled_from(["'s", "'S", "'re", "'ll", "'l", "''s", " '", "' ", "'", "\n", "\r\n", "\t", " ", "  ", "\x00", "\x1c", "\x85", "a", "Ab", "ve", "re", "12", "½", "!", "é", "日", "🎉", "​"]), st.characters())


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=5))
def test_array_split_equals_pattern(texts):
    assert encode.BYTE_PATTERN == PATTERN
    texts = [None, *(t.encode("utf-8", "ignore").decode() for t in texts), ""]
    found = encode.split_bytes_pattern(texts)
    got = [[] for _ in texts]
    for d, w in zip(found.doc.tolist(), found.which.tolist()):
        got[d].append(found.distinct[w])
    assert got == [encode.word_pattern(PATTERN).findall(t or "") for t in texts]


def test_array_split_does_not_trust_hashes(monkeypatch):
    """Words of equal hashes are told apart by their characters."""
    monkeypatch.setattr(encode.kernel, "span_hashes", lambda cp, a, b: np.zeros(len(a), np.uint64))
    found = encode.split_bytes_pattern(["one two", "two one"])
    assert [found.distinct[w] for w in found.which.tolist()] == ["one", " two", "two", " one"] and found.doc.tolist() == [0, 0, 1, 1]
