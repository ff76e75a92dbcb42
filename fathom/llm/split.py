"""Splitting oversized items at natural boundaries.

Method: balanced targets. The least number of pieces is computed, targets of equal length
are placed, each is snapped to the strongest boundary near it, and a piece is added while
any piece is over the limit.

A token is a longest run of letters and digits, or any other single character that is not
white space (non-breaking blanks are white space). Boundaries, strongest first: an empty
line, a line end (which also ends table rows and code lines), the end of a sentence, white
space, anything else.

Defined results: items of null, empty or blank text and items within the limit give no
piece; ``section_path`` and all other columns asked for are passed on as they are, nulls
included; repeated rows are split each by itself; an item without any boundary is cut
between tokens. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import kernel

MAX_TOKENS, OVERLAP = 512, 50
_SENTENCE_ENDS = np.array([ord(c) for c in ".!?;:…。！？"], np.uint32)
_FULL_WIDTH_ENDS = np.array([ord(c) for c in "。！？"], np.uint32)
_CLOSERS = np.array([ord(c) for c in "\"')]”’»」』"], np.uint32)


def token_spans(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the tokens of an array of code points."""
    flags = kernel.classes()[cp]
    word = (flags & kernel.ALNUM).astype(bool)
    other = (flags == 0) & (cp != 0)
    before = np.concatenate([[False], word[:-1]])
    after = np.concatenate([word[1:], [False]])
    starts = np.flatnonzero((word & ~before) | other)
    ends = np.flatnonzero((word & ~after) | other) + 1
    return starts, ends


def strengths(cp: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Strength of the boundary before each token: 4 empty line, 3 line end, 2 sentence end, 1 white space, 0 none."""
    out = np.zeros(len(starts), np.int8)
    if len(starts) < 2:
        return out
    line_ends = np.concatenate([[0], np.cumsum(cp == 10)])
    breaks = line_ends[starts[1:]] - line_ends[ends[:-1]]
    gap = starts[1:] > ends[:-1]
    out[1:][gap] = 1
    last = cp[ends[:-1] - 1]
    closing = np.isin(last, _CLOSERS)
    previous = np.concatenate([[0], last[:-1]]).astype(np.uint32)
    ended = np.isin(last, _SENTENCE_ENDS[:3]) | (closing & np.isin(previous, _SENTENCE_ENDS[:3]))
    out[1:][ended & gap] = 2
    out[1:][np.isin(last, _FULL_WIDTH_ENDS)] = 2
    out[1:][breaks == 1] = 3
    out[1:][breaks > 1] = 4
    return out


def cut_points(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Indexes of the tokens where pieces begin, 0 first; piece i repeats ``overlap`` tokens before its own."""
    n = len(strength)
    if n <= limit:
        return [0]
    overlap = min(overlap, limit - 1)
    pieces = max(2, -(-(n - overlap) // (limit - overlap)))
    while True:
        # own tokens of the first piece may fill the limit, those of the others leave room for the overlap
        room = n - overlap
        targets = [overlap + round(room * k / pieces) for k in range(1, pieces)]
        reach = max(1, int(room / pieces * 0.45))
        cuts = [0]
        for k, target in enumerate(targets):
            left = pieces - k - 1
            own = limit - (overlap if k else 0)
            # the cut may not make this piece too long, nor leave more than the rest can hold
            lo = max(cuts[-1] + 1, target - reach, n - left * (limit - overlap))
            hi = min(cuts[-1] + own, target + reach, n - left)
            if lo > hi:
                break
            window = strength[lo : hi + 1].astype(np.float64)
            away = np.abs(np.arange(lo, hi + 1) - target) / (reach + 1)
            cuts.append(lo + int(np.argmax(window - away * 0.99)))
        else:
            sizes = [b - a + (overlap if i else 0) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], n]))]
            if max(sizes) <= limit:
                return cuts
        pieces += 1


def split_text(text: str, limit: int = MAX_TOKENS, overlap: int = OVERLAP) -> list[tuple[str, int, int, int]]:
    """Pieces of one text as (text, tokens, tokens repeated, offset of the first own character)."""
    cp = kernel.codepoints(text)
    starts, ends = token_spans(cp)
    if len(starts) <= limit:
        return []
    cuts = cut_points(strengths(cp, starts, ends), limit, overlap)
    out = []
    for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(starts)])):
        first = max(0, a - overlap) if i else 0
        # the own characters of all pieces, white space before the next cut included, make up the text
        begin = 0 if not i else int(starts[first])
        stop = len(text) if b == len(starts) else int(starts[b])
        out.append((text[begin:stop], b - first, a - first, 0 if not i else int(starts[a])))
    return out


def split_oversized(df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", path_col: str = "section_path", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of each item over the limit: (id, piece_index, piece_count, section_path, token_count, overlap_tokens, own_start, text).

    Narrow: no shuffle, each row by itself. Rows that cannot be over the limit, as they
    have no more characters than it allows tokens, stay in the JVM's filter.
    """
    id_type = df.schema[id_col].dataType
    picked = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path")).where(F.length("text") > max_tokens)
    schema = T.StructType(
        [
            T.StructField(id_col, id_type),
            T.StructField("piece_index", T.IntegerType()),
            T.StructField("piece_count", T.IntegerType()),
            T.StructField("section_path", T.StringType()),
            T.StructField("token_count", T.IntegerType()),
            T.StructField("overlap_tokens", T.IntegerType()),
            T.StructField("own_start", T.IntegerType()),
            T.StructField("text", T.StringType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            row, idx, count, tokens, repeated, own, pieces = [], [], [], [], [], [], []
            for lo, hi in kernel.blocks(texts):
                text, bounds = kernel.join(texts[lo:hi])
                starts, _ = token_spans(kernel.codepoints(text))
                over = np.diff(np.searchsorted(starts, bounds)) > max_tokens
                for r in np.flatnonzero(over):
                    cut = split_text(texts[lo + r], max_tokens, overlap)
                    row += [lo + int(r)] * len(cut)
                    idx += range(len(cut))
                    count += [len(cut)] * len(cut)
                    for t, n, o, s in cut:
                        pieces.append(t)
                        tokens.append(n)
                        repeated.append(o)
                        own.append(s)
            at = pa.array(row, pa.int64())
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(idx, i32), pa.array(count, i32), batch.column(2).take(at), pa.array(tokens, i32), pa.array(repeated, i32), pa.array(own, i32), pa.array(pieces, pa.string())],
                names=[f.name for f in schema],
            )

    return picked.mapInArrow(run, schema)
