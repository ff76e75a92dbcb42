"""Passages of evaluation items inside a training corpus.

Method: prefix-filtered set join. Items are cut into windows as long as the least passage
that counts (a shorter item is one window). A window's words make overlapping shingles; a
document that holds the window holds all of them, so the rarest one in the corpus is a
sufficient prefix to join by. A first pass over the corpus counts the shingles of the
items, a second one looks up prefixes only; each hit brings the words around it, the
prefix's place in its window fixes where the window would begin (positional bound) and end
(length bound), and the words there are compared one by one.

A word is a longest run of letters and digits (Unicode), in lower case. Defined results:
items and documents of null, empty or wordless text match nothing; repeated documents are
reported once for their id; items that share a passage are all reported; texts are
searched whole. Empty tables give an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm import kernel
from fathom.session import exact_unions, materialize

WINDOW, SHINGLE = 12, 3
#: Item shingles that go to the workers at once, as hashes of 8 bytes; of more, each such part makes a pass of its own over the corpus.
BROADCAST_SHINGLES = 1 << 20
#: Item windows up to this number are broadcast in the candidate join; beyond it the join shuffles.
BROADCAST_WINDOWS = 50_000
#: Hits that leave a worker at once.
HITS = 4096


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item_id, item_words, win_start, win_words, size, words, grams): each window, its words and the hashes of its shingles, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, total, start, length, size, words, grams = [], [], [], [], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                w = kernel.words([text])
                ws = [w.text[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
                if not ws:
                    continue
                n, k = min(window, len(ws)), min(shingle, len(ws))
                hashes = kernel.signed(kernel.shingles(w, k)[0])
                for s in range(len(ws) - n + 1):
                    ids.append(row)
                    total.append(len(ws))
                    start.append(s)
                    length.append(n)
                    size.append(k)
                    words.append(ws[s : s + n])
                    grams.append(hashes[s : s + n - k + 1])
            i32 = pa.int32()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(ids, pa.int64())), pa.array(total, i32), pa.array(start, i32), pa.array(length, i32), pa.array(size, i32), pa.array(words, pa.list_(pa.string())), pa.array(grams, pa.list_(pa.int64()))],
                names=["item_id", "item_words", "win_start", "win_words", "size", "words", "grams"],
            )

    picked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    kind = items.schema[id_col].dataType.simpleString()
    return picked.mapInArrow(run, f"item_id {kind}, item_words int, win_start int, win_words int, size int, words array<string>, grams array<long>")


def _parts(grams: DataFrame, limit: int) -> Iterator[dict[int, np.ndarray]]:
    """The hashes of grams (size, gram) by size, at most about ``limit`` of them at a time."""
    parts = -(-grams.count() // max(limit, 1))
    for part in range(parts):
        mine = grams if parts == 1 else grams.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part)
        got = mine.select("size", "gram").toArrow()
        size, gram = got.column(0).to_numpy(), got.column(1).to_numpy().astype(np.int64).view(np.uint64)
        yield {int(k): np.unique(gram[size == k]) for k in np.unique(size)}


def document_counts(docs: DataFrame, grams: DataFrame, text_col: str, limit: int) -> DataFrame:
    """(size, gram, docs): in how many texts each shingle of the items stands. Counted in each task before the shuffle."""
    picked = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
    counted: DataFrame | None = None
    for members in _parts(grams, limit):
        shared = docs.sparkSession.sparkContext.broadcast(members)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sets = {k: kernel.HashSet(v) for k, v in shared.value.items()}
            total = {k: np.zeros(len(s.members), np.int64) for k, s in sets.items()}
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for lo, hi in kernel.blocks(texts):
                    w = kernel.words(texts[lo:hi])
                    for k, s in sets.items():
                        h, first = kernel.shingles(w, k)
                        at = s.positions(h)
                        if len(at):
                            which = np.searchsorted(s.members, h[at])
                            once = np.unique(w.doc[first[at]] * len(s.members) + which) % len(s.members)
                            np.add.at(total[k], once, 1)
            for k, s in sets.items():
                met = np.flatnonzero(total[k])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), k, np.int32)), pa.array(kernel.signed(s.members[met])), pa.array(total[k][met])], names=["size", "gram", "docs"])

        part = picked.mapInArrow(run, "size int, gram long, docs long")
        counted = part if counted is None else counted.unionByName(part)
    if counted is None:
        return grams.select("size", "gram", F.lit(0).cast("long").alias("docs")).limit(0)
    return counted.groupBy("size", "gram").agg(F.sum("docs").alias("docs"))


def prefix_hits(docs: DataFrame, prefixes: DataFrame, id_col: str, text_col: str, window: int, limit: int) -> DataFrame:
    """(doc_id, size, gram, at, around): where a document has a prefix (size, gram): the words around it, and its place among them."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, size int, gram long, at int, around array<string>"
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    found: DataFrame | None = None
    for members in _parts(prefixes, limit):
        shared = docs.sparkSession.sparkContext.broadcast(members)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sets = {k: kernel.HashSet(v) for k, v in shared.value.items()}
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in kernel.blocks(texts):
                    w = kernel.words(texts[lo:hi])
                    ends = np.cumsum(np.bincount(w.doc, minlength=hi - lo))
                    for k, s in sets.items():
                        h, first = kernel.shingles(w, k)
                        hit = s.positions(h)
                        for step in range(0, len(hit), HITS):
                            mine = hit[step : step + HITS]
                            place, doc = first[mine], w.doc[first[mine]]
                            begin = np.maximum(place - (window - k), np.concatenate([[0], ends])[doc])
                            stop = np.minimum(place + window, ends[doc])
                            around = [[w.text[a:b] for a, b in zip(w.start[x:y].tolist(), w.end[x:y].tolist())] for x, y in zip(begin.tolist(), stop.tolist())]
                            yield pa.RecordBatch.from_arrays(
                                [batch.column(0).take(pa.array(lo + doc)), pa.array(np.full(len(mine), k, np.int32)), pa.array(kernel.signed(h[mine])), pa.array((place - begin).astype(np.int32)), pa.array(around, pa.list_(pa.string()))],
                                names=["doc_id", "size", "gram", "at", "around"],
                            )

        part = picked.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def leaked_windows(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_shingles: int = BROADCAST_SHINGLES, broadcast_windows: int = BROADCAST_WINDOWS
) -> DataFrame:
    """(doc_id, item_id, item_words, win_start, win_words): every window of an item that stands word for word in a document."""
    exact_unions(docs.sparkSession)
    windows = materialize(item_windows(items, item_id, item_text, window, shingle), "windows")
    grams = materialize(windows.select("size", F.explode("grams").alias("gram")).distinct(), "grams")
    rarity = materialize(document_counts(docs, grams, doc_text, broadcast_shingles), "rarity")

    # the rarest shingle of a window; a window with a shingle that no document has is nowhere
    key = ("item_id", "item_words", "win_start", "win_words", "size", "words")
    parts = windows.select(*key, F.posexplode("grams").alias("off", "gram")).join(rarity, ["size", "gram"], "left")
    rarest = parts.groupBy(*key).agg(F.min(F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "gram", "off")).alias("rarest")).where("rarest.docs > 0")
    prefix = materialize(rarest.select(*key, F.col("rarest.gram").alias("gram"), F.col("rarest.off").alias("off")), "prefix")
    hits = prefix_hits(docs, prefix.select("size", "gram").distinct(), doc_id, doc_text, window, broadcast_shingles)
    asked = F.broadcast(prefix) if prefix.count() <= broadcast_windows else prefix
    begin = F.col("at") - F.col("off")
    return (
        hits.join(asked, ["size", "gram"])
        .where((begin >= 0) & (begin + F.col("win_words") <= F.size("around")))
        .where(F.slice("around", begin + 1, F.col("win_words")) == F.col("words"))
        .select("doc_id", "item_id", "item_words", "win_start", "win_words")
        .distinct()
    )


def leaked_items(windows: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, covered): windows found, and the share of the item's words that they cover together."""
    words = windows.select("doc_id", "item_id", "item_words", F.explode(F.expr("sequence(win_start, win_start + win_words - 1)")).alias("word"))
    covered = words.distinct().groupBy("doc_id", "item_id").agg((F.count("*") / F.first("item_words")).alias("covered"))
    return windows.groupBy("doc_id", "item_id").agg(F.count("*").alias("windows")).join(covered, ["doc_id", "item_id"])
