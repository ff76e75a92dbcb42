"""Encoding of a corpus with a public byte-level BPE tokenizer.

Method: minimal acyclic transducer lexicon. The corpus's frequent words are compiled,
with their token ids as output, into an automaton that shares suffixes; executors map it
into memory; words that are not in it are merged exactly.

Defined results: null and empty texts give an empty list; strings that look like special
tokens are ordinary text; rows that repeat are encoded each by itself; all texts are
encoded whole. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import io
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import cache, lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathom.llm import kernel
from fathom.session import materialize, write_shared_file

#: White space as the tokenizer's own pattern has it (the Unicode property), which Python's ``\s`` is not.
_WHITE = r"\t-\r \x85\xa0  -     　"
#: Fixed value: the pre-tokenisation pattern that belongs to the public byte-level vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are split at once.
BLOCK_CHARS = 1 << 20
_WHITE_KIND, _LETTER, _NUMBER, _OTHER, _MARK = range(5)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a ``.tiktoken`` vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def word_pattern(pattern: str):
    """The tokenizer's pre-tokenisation, with white space spelled out."""
    import regex

    inside = pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"(?!\S)", f"(?![^{_WHITE}])").replace(r"\s", f"[{_WHITE}]")
    return regex.compile(inside)


class Split(NamedTuple):
    """Words of some texts: which text each is of, which of the distinct words it is, and these."""

    doc: np.ndarray
    which: np.ndarray
    distinct: list[str]


@cache
def _kinds() -> np.ndarray:
    """Letter, number, white space or other of each code point; the place after the last one is the mark between texts."""
    import regex

    table = np.full(0x110001, _OTHER, np.uint8)
    table[-1] = _MARK
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    code = lambda i: i if i < 0xD800 else i + 0x800
    for kind, inside in ((_WHITE_KIND, f"[{_WHITE}]+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(inside, every):
            table[code(m.start()) : code(m.end() - 1) + 1] = kind
    return table


def split_bytes_pattern(texts: Sequence[str | None]) -> Split:
    """What ``BYTE_PATTERN`` finds in the texts, by whole-array steps over code points."""
    parts = [t or "" for t in texts]
    body = "".join(parts)
    cp = np.insert(kernel.codepoints(body), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts))), 0x110000)
    kind = _kinds()[cp]
    mark, white = kind == _MARK, kind == _WHITE_KIND
    start = mark.copy()
    start[:1] = True
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before something solid stands by itself, and a blank there leads the word that follows
    last = white.copy()
    last[:-1] &= ~(white | mark)[1:]
    last[-1:] = False
    start |= last
    start[1:][last[:-1] & (cp[:-1] == 32)] = False
    # contractions: an apostrophe that begins a word and stands before these letters
    at = np.flatnonzero(start & (cp == ord("'")))
    at = at[kind[at + 1] == _LETTER]
    one, two = cp[at + 1], cp[np.minimum(at + 2, len(cp) - 1)]
    is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    is_one = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    at, length = at[is_one | is_two], np.where(is_two, 2, 1)[is_one | is_two]
    start[at + 1] = False
    after = at + 1 + length
    start[after[kind[after] == _LETTER]] = True

    begin = np.flatnonzero(start)
    end = np.append(begin[1:], len(cp))
    solid = ~mark[begin]
    begin, end = begin[solid], end[solid]
    doc = np.searchsorted(np.flatnonzero(mark), begin)
    _, first, which = np.unique(kernel.span_hashes(cp, begin, end), return_index=True, return_inverse=True)
    # equal hashes are equal words only if their characters are
    size, head = end - begin, first[which]
    same = bool((size == size[head]).all())
    if same:
        here = np.flatnonzero(~mark)
        same = bool((cp[here] == cp[here + np.repeat(begin[head] - begin, size)]).all())
    if not same:
        return _numbered([body[a:b] for a, b in zip((begin - doc).tolist(), (end - doc).tolist())], doc)
    return Split(doc, which, [body[a:b] for a, b in zip((begin - doc)[first].tolist(), (end - doc)[first].tolist())])


def _numbered(words: list[str], doc: np.ndarray) -> Split:
    number: dict[str, int] = {}
    which = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return Split(doc, which, list(number))


def splitter(pattern: str):
    """The function that splits texts by a pattern: whole arrays for the pattern of the byte-level vocabularies, else regular expressions."""
    if pattern == BYTE_PATTERN:
        return split_bytes_pattern
    find = word_pattern(pattern).findall

    def split(texts: Sequence[str | None]) -> Split:
        found = [find(t) if t else [] for t in texts]
        return _numbered(list(chain.from_iterable(found)), np.repeat(np.arange(len(found)), [len(f) for f in found]))

    return split


def merge_exact(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte pair merges of one word, lowest rank first, leftmost among equals."""
    known = ranks.get(word)
    if known is not None:
        return [known]
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    """A minimal acyclic automaton over byte strings. Each arc adds the number of words that
    leave before it; the sum along a word's path is its place in sorted order, which points
    into the table of outputs. The numbers belong to states, so that equal suffixes stay shared.
    """

    def __init__(self, keys: np.ndarray, targets: np.ndarray, adds: np.ndarray, final: np.ndarray, root: int, offsets: np.ndarray, ids: np.ndarray) -> None:
        self.keys, self.targets, self.adds, self.final = keys, targets, adds, final
        self.root, self.offsets, self.ids = root, offsets, ids

    @classmethod
    def build(cls, entries: dict[bytes, Sequence[int]]) -> Transducer:
        order = sorted(entries)
        register: dict[tuple, int] = {}
        arcs: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(final: bool, out: dict[int, int]) -> int:
            key = (final, tuple(out.items()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(arcs)
                arcs.append(key)
            return state

        # path[i] is the open state after i bytes of the latest word
        path: list[list] = [[False, {}]]
        last = b""
        for word in order:
            common = 0
            while common < min(len(word), len(last)) and word[common] == last[common]:
                common += 1
            for depth in range(len(last), common, -1):
                final, out = path.pop()
                path[-1][1][last[depth - 1]] = freeze(final, out)
            path.extend([False, {}] for _ in range(len(word) - common))
            path[-1][0] = True
            last = word
        for depth in range(len(last), 0, -1):
            final, out = path.pop()
            path[-1][1][last[depth - 1]] = freeze(final, out)
        root = freeze(*path[0])

        words_below = np.zeros(len(arcs), np.int64)
        keys, targets, adds = [], [], []
        for state, (final, out) in enumerate(arcs):  # targets are frozen before their sources
            total = int(final)
            for label, target in out:
                keys.append(state << 8 | label)
                targets.append(target)
                adds.append(total)
                total += int(words_below[target])
            words_below[state] = total
        offsets = np.zeros(len(order) + 1, np.int64)
        np.cumsum([len(entries[w]) for w in order], out=offsets[1:])
        ids = np.array([i for w in order for i in entries[w]], np.int32)
        return cls(np.array(keys, np.int64), np.array(targets, np.int32), np.array(adds, np.int32), np.array([f for f, _ in arcs], bool), root, offsets, ids)

    def places(self, words: Sequence[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, -1 where it is not in it; all words walk one byte a step."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        data = np.frombuffer(b"".join(words), np.uint8)
        begin = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        state, place = np.full(n, self.root, np.int64), np.zeros(n, np.int64)
        alive, step = np.flatnonzero(lengths > 0), 0
        dead = lengths == 0
        while len(alive) and len(self.keys):
            key = state[alive] << 8 | data[begin[alive] + step]
            at = np.searchsorted(self.keys, key)
            at[at == len(self.keys)] = 0
            good = self.keys[at] == key
            dead[alive[~good]] = True
            alive, at = alive[good], at[good]
            state[alive] = self.targets[at]
            place[alive] += self.adds[at]
            step += 1
            alive = alive[lengths[alive] > step]
        dead |= ~self.final[state] if len(self.keys) else True
        place[dead] = -1
        return place

    def output(self, place: int) -> list[int]:
        return self.ids[self.offsets[place] : self.offsets[place + 1]].tolist()

    _PARTS = ("keys", "targets", "adds", "final", "offsets", "ids")

    def dump(self) -> bytes:
        """One file: each array in numpy's own format, one after the other, each on a 64-byte boundary."""
        out = io.BytesIO()
        for name in self._PARTS:
            np.save(out, getattr(self, name))
            out.write(b"\0" * (-out.tell() % 64))
        np.save(out, np.array([self.root], np.int64))
        return out.getvalue()

    @classmethod
    def map(cls, path: str) -> Transducer:
        """Maps a dumped automaton into memory: its pages are shared by all workers of a machine."""
        parts = {}
        with open(path, "rb") as f:
            for name in [*cls._PARTS, "root"]:
                f.seek(-(-f.tell() // 64) * 64)
                np.lib.format.read_magic(f)
                shape, _, dtype = np.lib.format.read_array_header_1_0(f)
                size = int(np.prod(shape)) * dtype.itemsize
                parts[name] = np.memmap(path, dtype, "r", f.tell(), shape) if size else np.empty(shape, dtype)
                f.seek(size, 1)
        root = int(parts.pop("root")[0])
        return cls(root=root, **parts)


class Encoder:
    """Encodes texts of one worker. ``seen`` keeps the ids of words met lately; it is emptied at a bound."""

    SEEN = 1 << 19

    def __init__(self, vocabulary: str, pattern: str, lexicon: Transducer | None) -> None:
        self.ranks, self.split, self.lexicon = load_ranks(vocabulary), splitter(pattern), lexicon
        self.seen: dict[str, list[int]] = {}
        self.merge = self._merger()

    def _merger(self):
        try:
            import tiktoken

            piece = tiktoken.Encoding("fathom", pat_str=r"[\s\S]+", mergeable_ranks=self.ranks, special_tokens={})._encode_single_piece
            return lambda w: piece(w)
        except (ImportError, AttributeError):
            return lambda w: merge_exact(w, self.ranks)

    def learn(self, new: list[str]) -> None:
        raw = [w.encode() for w in new]
        if self.lexicon is None:
            for w, b in zip(new, raw):
                self.seen[w] = self.merge(b)
            return
        for w, b, p in zip(new, raw, self.lexicon.places(raw).tolist()):
            self.seen[w] = self.merge(b) if p < 0 else self.lexicon.output(p)

    def encode(self, texts: Sequence[str | None]) -> pa.ListArray:
        found = self.split(texts)
        if len(self.seen) > self.SEEN:
            self.seen.clear()
        seen = self.seen
        new = [w for w in found.distinct if w not in seen]
        if new:
            self.learn(new)
        lists = [seen[w] for w in found.distinct]
        # the ids of each distinct word lie one after the other; each word of a text points to its own
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
        begin = np.cumsum(size) - size
        many = size[found.which]
        place = np.cumsum(many) - many
        ids = flat[np.arange(int(many.sum())) + np.repeat(begin[found.which] - place, many)]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(np.bincount(found.doc, weights=many, minlength=len(texts)).astype(np.int64), out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))


def count_words(df: DataFrame, text_col: str, pattern: str) -> DataFrame:
    """Occurrences of each word over all texts: (word, n). Counted in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts = splitter(pattern), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in kernel.blocks(texts, BLOCK_CHARS):
                found = split(texts[lo:hi])
                for w, n in zip(found.distinct, np.bincount(found.which, minlength=len(found.distinct)).tolist()):
                    counts[w] += n
            if len(counts) > 400_000:
                yield flush()
        yield flush()

    return df.select(F.col(text_col).alias("text")).where(F.length("text") > 0).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame, size: int) -> list[str]:
    """The words over the least count that no more than ``size`` words reach: the bound of what comes to the driver.

    The count is found from a histogram of counts (16 steps to a doubling), so that no task
    sends a list of its own.
    """
    counts = materialize(counts.where(F.col("n") > 1).withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "word-counts")
    least, total = None, 0
    for step, n in counts.groupBy("step").count().orderBy(F.desc("step")).collect():
        if total + n > size:
            break
        least, total = step, total + n
    return [] if least is None else [r.word for r in counts.where(F.col("step") >= least).select("word").collect()]


def build_lexicon(spark: SparkSession, words: Sequence[str], vocabulary: str, pattern: str) -> str:
    """Compiles the words into an automaton file that each executor fetches once; returns the file's name."""
    encoder = Encoder(vocabulary, pattern, None)
    path = write_shared_file(spark, "lexicon", Transducer.build({w.encode(): encoder.merge(w.encode()) for w in words}).dump())
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def encode_corpus(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", lexicon_size: int = 1 << 16) -> DataFrame:
    """(id, ids): the token ids of each text, without special tokens.

    vocabulary: path of a ``.tiktoken`` file, present on every machine; pattern: its
    pre-tokenisation. lexicon_size bounds the automaton (some 2 MB) and the words that
    come to the driver; every other word is merged where it stands.
    """
    spark = df.sparkSession
    name = build_lexicon(spark, frequent_words(count_words(df, text_col, pattern), lexicon_size), vocabulary, pattern)
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary, pattern, Transducer.map(SparkFiles.get(name)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernel.blocks(texts, BLOCK_CHARS):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), encoder.encode(texts[lo:hi])], names=[id_col, "ids"])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode_corpus(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text): the texts that lists of token ids spell out; null lists give null. Narrow."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = {i: b for b, i in load_ranks(vocabulary).items()}
        for batch in batches:
            texts = [None if ids is None else b"".join(map(piece.__getitem__, ids)).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(id_col, ids_col).mapInArrow(run, schema)
