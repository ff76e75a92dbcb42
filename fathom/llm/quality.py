"""Per-document text statistics and text types.

Method: thresholds on statistics are noisy labelling functions. Each says prose, not prose
or nothing of a segment (a sentence, or what stands between two sentence ends or empty
lines); expectation-maximisation on how they agree over all segments of the corpus learns
what each vote is worth; a segment's posterior follows from its votes, a document's prose
share from its segments' characters.

Defined results: null, empty and blank texts have word count 0, null ratios, null posterior
and type ``empty``; repeated rows are each rated by themselves; null common words are left
out; a corpus of one row is rated by the starting accuracies pulled by that row alone. An
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import kernel
from fathom.session import materialize

#: Common words up to this number are sent to the workers as hashes of 8 bytes; more are joined to the words of the texts by shuffle.
BROADCAST_WORDS = 100_000
VOTES = ("common", "kana", "ends", "symbols", "digits", "length", "repeats", "lines", "glyphs")
#: How a good vote is believed at the start: the chance that it is right, when it is cast.
START = 0.8

_ENDS = np.array([ord(c) for c in ".!?…"], np.uint32)
_WIDE_ENDS = np.array([ord(c) for c in "。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]”’»」』*"], np.uint32)
_SOFT = np.array([ord(c) for c in ".,;:!?'’\"“”«»()-–—…。、！？「」%*_"], np.uint32)
_MARKS = np.array([ord(c) for c in "|{}[]<>=#\\^~`•›§$&@¤/+"], np.uint32)

STATS = T.StructType(
    [
        T.StructField("word_count", T.LongType()),
        T.StructField("mean_word_length", T.DoubleType()),
        T.StructField("symbol_ratio", T.DoubleType()),
        T.StructField("punct_line_share", T.DoubleType()),
        T.StructField("common_word_share", T.DoubleType()),
        T.StructField("patterns", T.ArrayType(T.IntegerType())),
        T.StructField("chars", T.ArrayType(T.LongType())),
        T.StructField("segments", T.ArrayType(T.LongType())),
    ]
)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def _vote(yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """2 prose, 1 not prose, 0 nothing."""
    return np.where(yes, 2, np.where(no, 1, 0)).astype(np.int32)


class OwnSets:
    """Common words that each text of a block brings along, in the place of one set for all."""

    def __init__(self, lists: pa.ListArray) -> None:
        counts = np.diff(lists.offsets.to_numpy())
        self.members = kernel.HashSet(self._key(lists.flatten().to_numpy().astype(np.int64).view(np.uint64), np.repeat(np.arange(len(counts)), counts)))

    @staticmethod
    def _key(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        return kernel.mix(hashes + kernel.mix(doc.astype(np.uint64) + np.uint64(1)))

    def of(self, w: kernel.Words) -> np.ndarray:
        return self.members.positions(self._key(w.hash, w.doc))


class OneSet:
    """Common words that are the same for all texts."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.members = kernel.HashSet(hashes)

    def of(self, w: kernel.Words) -> np.ndarray:
        return self.members.positions(w.hash)


def rate_block(texts: list[str | None], common: OneSet | OwnSets) -> dict[str, list]:
    """Statistics of each text, and its characters and segments by voting pattern."""
    clean = [t.replace("\r\n", "\n").replace("\r", "\n").replace(" ", "\n").replace("\x85", "\n") if t else t for t in texts]
    w = kernel.words(clean)
    cp, bounds, n = w.cp, w.bounds, len(texts)
    flags = kernel.classes()[cp]
    solid = (flags & kernel.SPACE == 0) & (cp != 0)
    space = ~solid
    alnum = flags & kernel.ALNUM > 0
    symbol = solid & ~alnum
    is_common = np.zeros(len(w.hash), bool)
    is_common[common.of(w)] = True

    def cum(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x) + 1, np.int64)
        np.cumsum(x, out=out[1:])
        return out

    c_solid, c_symbol = cum(solid), cum(symbol)
    # lines: ended by a line feed or the end of a text
    line_end = np.flatnonzero((cp == 10) | (cp == 0))
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    line_doc = np.searchsorted(bounds, line_start, "right") - 1
    filled = c_solid[line_end] > c_solid[line_start]
    # last character of a line that is no white space
    index = np.where(solid, np.arange(len(cp)), 0)
    last_solid = np.maximum.accumulate(index)
    closing = np.isin(cp, _CLOSERS)
    last_open = np.maximum.accumulate(np.where(solid & ~closing, np.arange(len(cp)), 0))
    tail = cp[last_open[np.maximum(line_end - 1, 0)]]
    line_punct = filled & (last_open[np.maximum(line_end - 1, 0)] >= line_start) & (np.isin(tail, _ENDS) | np.isin(tail, _WIDE_ENDS))

    lines = np.bincount(line_doc[filled], minlength=n)
    punct_lines = np.bincount(line_doc[line_punct], minlength=n)
    n_words = np.bincount(w.doc, minlength=n)
    word_chars = np.bincount(w.doc, weights=w.end - w.start, minlength=n)
    commons = np.bincount(w.doc, weights=is_common, minlength=n)
    doc_solid, doc_symbol = np.diff(c_solid[bounds]), np.diff(c_symbol[bounds])

    # segments end after a sentence's end, at an empty line and at a text's end
    at_end = np.isin(cp, _ENDS) | (closing & np.concatenate([[False], np.isin(cp[:-1], _ENDS)]))
    cut = at_end & np.concatenate([space[1:], [True]])
    cut |= np.isin(cp, _WIDE_ENDS)
    empty = line_end[1:][(c_solid[line_end[1:]] == c_solid[line_end[:-1]]) & (cp[line_end[:-1]] == 10)]
    cut[empty] = True
    cut[cp == 0] = True
    seg_end = np.flatnonzero(cut) + 1
    seg_start = np.concatenate([[0], seg_end[:-1]])
    chars = c_solid[seg_end] - c_solid[seg_start]
    keep = chars > 0
    seg_start, seg_end, chars = seg_start[keep], seg_end[keep], chars[keep]
    m = len(chars)
    seg_doc = np.searchsorted(bounds, seg_start, "right") - 1

    def per(x: np.ndarray) -> np.ndarray:
        c = cum(x)
        return c[seg_end] - c[seg_start]

    digits, letters = per(alnum & (flags & kernel.ALPHA == 0)), per(flags & kernel.ALPHA > 0)
    kana = per(flags & kernel.KANA > 0)
    wide = per((cp >= 0x3040) & (cp <= 0x9FFF) & alnum)
    hard = per(symbol & ~np.isin(cp, _SOFT))
    marks = per(np.isin(cp, _MARKS))
    feeds = per(cp == 10)
    word_seg = np.searchsorted(seg_end, w.start, "right")
    word_seg = np.minimum(word_seg, max(m - 1, 0))
    seg_words = np.bincount(word_seg, minlength=m)[:m] if m else np.zeros(0)
    seg_common = np.bincount(word_seg, weights=is_common, minlength=m)[:m] if m else np.zeros(0)
    # characters of lines that stand at least three times in their text
    line_hash = kernel.span_hashes(cp, line_start, line_end) ^ kernel.mix(line_doc.astype(np.uint64) + np.uint64(7))
    _, which, times = np.unique(line_hash, return_inverse=True, return_counts=True)
    often = (times[which] >= 3) & filled
    step = np.zeros(len(cp) + 1, np.int64)
    np.add.at(step, line_start[often], 1)
    np.add.at(step, line_end[often], -1)
    repeated = per((np.cumsum(step)[:-1] > 0) & solid)

    end_char = cp[last_open[seg_end - 1]]
    ends = (np.isin(end_char, _ENDS) | np.isin(end_char, _WIDE_ENDS)) & (last_open[seg_end - 1] >= seg_start)
    share, japanese = _ratio(seg_common, seg_words), wide > 0.4 * letters
    hard_ratio, digit_ratio, kana_ratio = _ratio(hard, chars), _ratio(digits, chars), _ratio(kana, letters)
    per_line = _ratio(seg_words, feeds + 1.0)
    size = np.where(japanese, letters / 2.5, seg_words)
    long_word = _ratio(letters + digits, seg_words)
    votes = [
        _vote(~japanese & (share >= 0.15), ~japanese & (share < 0.09)),
        _vote(japanese & (kana_ratio >= 0.25), japanese & (kana_ratio < 0.15)),
        _vote(ends, ~ends),
        _vote(hard_ratio < 0.03, hard_ratio > 0.08),
        _vote(digit_ratio < 0.12, digit_ratio > 0.2),
        _vote((size >= 6) & (size <= 45), (size < 4) | (size > 70)),
        _vote(np.zeros(m, bool), repeated > 0.5 * chars),
        _vote(~japanese & (per_line >= 7), ~japanese & (per_line < 3.5)),
        _vote((marks == 0) & (japanese | (long_word < 9)), (marks > 0.04 * chars) | (~japanese & (long_word > 14))),
    ]
    pattern = np.zeros(m, np.int32)
    for v in votes:
        pattern = pattern * 3 + v
    key = seg_doc.astype(np.int64) * 3 ** len(VOTES) + pattern
    distinct, which = np.unique(key, return_inverse=True)
    by_chars = np.bincount(which, weights=chars, minlength=len(distinct)).astype(np.int64)
    by_count = np.bincount(which, minlength=len(distinct)).astype(np.int64)
    doc_of, pat = distinct // 3 ** len(VOTES), (distinct % 3 ** len(VOTES)).astype(np.int32)
    split = np.searchsorted(doc_of, np.arange(n + 1))
    has = doc_solid > 0

    def ratio(a: np.ndarray, b: np.ndarray) -> pa.Array:
        return pa.array(_ratio(a.astype(float), b.astype(float)), mask=~(b > 0))

    offsets = pa.array(split.astype(np.int32))
    return {
        "word_count": pa.array(n_words.astype(np.int64)),
        "mean_word_length": ratio(word_chars, n_words),
        "symbol_ratio": ratio(doc_symbol, doc_solid),
        "punct_line_share": ratio(punct_lines, np.where(has, lines, 0)),
        "common_word_share": ratio(commons, n_words),
        "patterns": pa.ListArray.from_arrays(offsets, pa.array(pat)),
        "chars": pa.ListArray.from_arrays(offsets, pa.array(by_chars)),
        "segments": pa.ListArray.from_arrays(offsets, pa.array(by_count)),
    }


def learn(pattern: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over patterns of votes: (chance of each vote by type and labelling function, share of prose, posterior of each pattern).

    Types are 0 not prose, 1 prose; a labelling function's silence tells too.
    """
    k = len(VOTES)
    digits = np.stack([(pattern // 3 ** (k - 1 - j)) % 3 for j in range(k)], 1)
    one = np.zeros((len(pattern), k, 3))
    np.put_along_axis(one, digits[:, :, None], 1.0, 2)
    theta = np.zeros((2, k, 3))
    silent = (one[:, :, 0] * weight[:, None]).sum(0) / max(weight.sum(), 1e-9)
    for t in (0, 1):
        theta[t, :, 0] = np.clip(silent, 0.02, 0.96)
        right, wrong = START * (1 - theta[t, :, 0]), (1 - START) * (1 - theta[t, :, 0])
        theta[t, :, 2] = right if t else wrong
        theta[t, :, 1] = wrong if t else right
    prior, post = 0.5, np.zeros(len(pattern))
    for _ in range(rounds):
        score = np.log(np.stack([1 - prior, np.asarray(prior)])) + np.einsum("njv,tjv->nt", one, np.log(theta))
        new = 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))
        moved, post = np.abs(new - post).max(initial=0), new
        both = np.stack([1 - post, post]) * weight
        counts = np.einsum("tn,njv->tjv", both, one) + np.where(np.arange(3) > 0, 1.0, 1.0)
        theta = counts / counts.sum(2, keepdims=True)
        prior = float(np.clip(both[1].sum() / max(both.sum(), 1e-9), 0.02, 0.98))
        if moved < 1e-6:
            break
    return theta, prior, post


def _with_own_words(df: DataFrame, hashes: DataFrame, text_col: str) -> DataFrame:
    """The rows with ``_own``: the hashes of those of their words that are in the table of hashes (h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernel.blocks(texts):
                w = kernel.words(texts[lo:hi])
                order = np.lexsort((w.hash, w.doc))
                doc, h = w.doc[order], w.hash[order]
                fresh = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(doc) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + doc[fresh])), pa.array(kernel.signed(h[fresh]))], names=["key", "h"])

    keyed = df.withColumn("_key", F.xxhash64(text_col))
    pairs = keyed.select("_key", text_col).where(F.length(text_col) > 0).mapInArrow(run, "key long, h long").join(hashes, "h", "left_semi").distinct()
    own = pairs.groupBy(F.col("key").alias("_key")).agg(F.collect_list("h").alias("_own"))
    return keyed.join(own, "_key", "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<bigint>"))).drop("_key")


def _word_hashes(common_words: DataFrame, word_col: str) -> DataFrame:
    """(h) of the distinct common words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(kernel.words(batch.column(0).to_pylist()).hash))], names=["h"])

    return common_words.select(F.lower(F.trim(word_col)).alias("w")).where(F.length("w") > 0).mapInArrow(run, "h long").distinct()


def document_statistics(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(id, word_count, mean_word_length, symbol_ratio, punct_line_share, common_word_share, patterns, chars, segments).

    One pass over the texts, no shuffle; with more than ``broadcast_words`` common words, one join of the distinct words of each text.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *STATS])
    words = materialize(_word_hashes(common_words, word_col), "common-words")
    few = words.count() <= broadcast_words
    hashes = words.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64) if few else None
    rows = df.select(F.col(id_col), F.col(text_col)) if few else _with_own_words(df.select(F.col(id_col), F.col(text_col)), words, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = OneSet(hashes) if few else None
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernel.blocks(texts):
                out = rate_block(texts[lo:hi], common or OwnSets(batch.column(2).slice(lo, hi - lo)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *out.values()], names=[id_col, *out])

    return rows.mapInArrow(measure, schema)


def rate_documents(df: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text_col: str = "text", word_col: str = "word", broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(id, word_count, mean_word_length, symbol_ratio, punct_line_share, common_word_share, prose_share, text_type).

    prose_share is the posterior share of the characters, white space aside, that belong to
    running prose; text_type is prose, other or empty. One pass over the texts; pattern
    counts are shuffled, of which there are at most 3 to the power of the votes.
    """
    stats = materialize(document_statistics(df, common_words, id_col, text_col, word_col, broadcast_words), "quality")
    patterns = stats.select(F.explode(F.arrays_zip("patterns", "segments")).alias("x")).groupBy(F.col("x.patterns").alias("pattern")).agg(F.sum("x.segments").alias("n")).orderBy("pattern").collect()
    known = np.array([r.pattern for r in patterns], np.int64)
    _, _, post = learn(known, np.array([r.n for r in patterns], float))
    final = T.StructType([*stats.schema.fields[:6], T.StructField("prose_share", T.DoubleType()), T.StructField("text_type", T.StringType())])

    def conclude(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pats, chars = batch.column(6), batch.column(7)
            counts = np.diff(pats.offsets.to_numpy())
            owner = np.repeat(np.arange(len(counts)), counts)
            p = post[np.searchsorted(known, pats.flatten().to_numpy())] if len(known) else np.empty(0)
            c = chars.flatten().to_numpy().astype(float)
            total = np.bincount(owner, weights=c, minlength=len(counts))
            prose = _ratio(np.bincount(owner, weights=c * p, minlength=len(counts)), total)
            kind = np.where(total == 0, "empty", np.where(prose >= 0.5, "prose", "other"))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(prose, mask=total == 0), pa.array(kind.tolist(), pa.string())], names=[f.name for f in final])

    return stats.mapInArrow(conclude, final)
