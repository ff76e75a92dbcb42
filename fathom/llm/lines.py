"""Lines repeated across the documents of one source.

Method: numbers, dates and names are masked, lines are clustered within their source by
locality-sensitive hashing of the masked words, and clusters that stand in many documents
of the source are removed.

Lines are what stands between line feeds, counted from 0, empty ones included. Lines whose
letters are the same, in order and without regard to case, are one line; a source's
distinct lines are what is clustered, so that a line in a million documents is one node.
Of two lines of a bucket the more frequent one may lead the other, if the sets of their
masked pairs of words are similar (``similar``); a leader joins no other line: clusters
are stars, whatever lies between them. Buckets of very many lines are cut by their lines'
rarest pairs of words, which parts no two similar lines. Lines of few words of their own
(``PLAIN``) or mostly of masks say too little and stay by themselves.

Defined results: records of null or empty text, without source or whose document is not
there take no part; lines under ``min_letters`` letters are left alone; a line counts once
for each document, however often it stands there; repeated rows count once; empty tables
give empty tables.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm import kernel
from fathom.llm.neardup import signatures
from fathom.session import exact_unions, materialize

MIN_DOCUMENTS, MIN_LETTERS = 5, 12
#: Signature of a masked line: lines of similarity 0.8 meet with chance 0.98, of 0.9 with 0.9999, of 0.3 with 0.02.
BANDS, ROWS = 10, 5
#: Least similarity of a line to its cluster's leader; least number of unmasked words of a line that joins others.
SIMILAR, PLAIN = 0.8, 4
#: Buckets of more nodes are cut and led in rounds before they are paired off; rounds go on while one leaves no more than this share of the pairs.
PAIRED, PAYS = 256, 0.9
#: Keys of shared buckets are broadcast up to this number (16 bytes each); beyond it they are joined by shuffle.
BROADCAST_KEYS = 1 << 20
MASK = np.uint64(0x5DEECE66D1234567)

#: Names of months, which are masked as parts of dates.
MONTHS = (
    "january february march april may june july august september october november december "
    "januar februar märz mai juni juli oktober dezember "
    "janvier février mars avril juin juillet août septembre octobre novembre décembre "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"
)


@cache
def _lower() -> np.ndarray:
    """The lower case of every code point that has one of a single code point."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x20000):
        low = chr(i).lower()
        if len(low) == 1:
            table[i] = ord(low)
    return table


@cache
def _months() -> np.ndarray:
    return np.unique(np.concatenate([kernel.words([m]).hash for m in MONTHS.split()]))


def _line_bounds(cp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    end = np.flatnonzero((cp == 10) | (cp == 0))
    return np.concatenate([[0], end[:-1] + 1]), end


def letter_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """For each line of the texts a hash of its letters without regard to case, and their number."""
    text, _ = kernel.join([t.casefold() if t else t for t in texts])
    cp = kernel.codepoints(text)
    start, end = _line_bounds(cp)
    alpha = kernel.classes()[cp] & kernel.ALPHA > 0
    before = np.zeros(len(cp) + 1, np.int64)
    np.cumsum(alpha, out=before[1:])
    letters = cp[alpha]
    a, b = before[start], before[end]
    return kernel.span_hashes(np.append(letters, np.uint32(0)), a, b), b - a


def masked_words(cp: np.ndarray, line_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in lower case, numbers, dates and names masked, and the line of each."""
    flags = kernel.classes()[cp]
    padded = np.zeros(len(cp) + 2, np.int8)
    padded[1:-1] = flags & kernel.ALNUM
    edges = np.flatnonzero(np.diff(padded))
    start, end = edges[::2], edges[1::2]
    line = np.searchsorted(line_start, start, "right") - 1
    hashes = kernel.span_hashes(_lower()[cp], start, end)
    digits = np.zeros(len(cp) + 1, np.int64)
    np.cumsum((flags & kernel.ALNUM > 0) & (flags & kernel.ALPHA == 0), out=digits[1:])
    capital = flags[start] & kernel.UPPER > 0
    words = np.bincount(line, minlength=len(line_start))
    capitals = np.bincount(line, weights=capital, minlength=len(line_start))
    first = np.concatenate([[True], line[1:] != line[:-1]]) if len(line) else np.zeros(0, bool)
    # in a line set in capitals throughout, they tell no name
    name = capital & ~first & (capitals[line] <= 0.5 * words[line])
    hashes[name | (digits[end] > digits[start]) | np.isin(hashes, _months())] = MASK
    return hashes, line


def line_forms(df: DataFrame, id_col: str, doc_col: str, text_col: str, min_letters: int) -> DataFrame:
    """(id, doc, line_no, letters, grams): each line of enough letters, its key, and hashes of its masked pairs of words.

    ``grams`` is empty where a line says too little to be like others.
    """
    kinds = (df.schema[id_col].dataType.simpleString(), df.schema[doc_col].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for lo, hi in kernel.blocks(texts):
                part = texts[lo:hi]
                key, letters = letter_keys(part)
                text, bounds = kernel.join(part)
                cp = kernel.codepoints(text)
                line_start, _ = _line_bounds(cp)
                row = np.searchsorted(bounds, line_start, "right") - 1
                number = np.arange(len(line_start)) - np.searchsorted(line_start, bounds[:-1])[row]
                wanted = np.flatnonzero(letters >= min_letters)
                if not len(wanted):
                    continue
                hashes, line = masked_words(cp, line_start)
                words = np.bincount(line, minlength=len(line_start))
                plain = np.bincount(line, weights=hashes != MASK, minlength=len(line_start))
                telling = (letters >= min_letters) & (plain >= PLAIN) & (2 * plain >= words)
                # pairs of neighbouring words; a line's last word stands for itself
                follow = np.concatenate([hashes[1:], [MASK]]) if len(hashes) else hashes
                last = np.concatenate([line[1:] != line[:-1], [True]]) if len(line) else np.zeros(0, bool)
                grams = kernel.mix(hashes * np.uint64(0x9FB21C651E98DF25) + np.where(last, np.uint64(11), follow))
                keep = telling[line]
                ends = np.concatenate([[0], np.cumsum((words * telling)[wanted])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array((grams[keep] >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                at = pa.array(lo + row[wanted])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(number[wanted], pa.int32()), pa.array(kernel.signed(key[wanted])), lists], names=["id", "doc", "line_no", "letters", "grams"])

    picked = df.select(F.col(id_col).alias("id"), F.col(doc_col).alias("doc"), F.col(text_col).alias("text")).where(F.length("text") >= min_letters)
    return picked.mapInArrow(run, f"id {kinds[0]}, doc {kinds[1]}, line_no int, letters long, grams array<int>")


def with_bands(nodes: DataFrame) -> DataFrame:
    """(node, rank, grams, bands) of nodes (node, src, rank, grams): the keys of each signature's bands, a source's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = kernel.mix(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            ends = lists.offsets.to_numpy().astype(np.int64)
            grams = kernel.mix(lists.flatten().to_numpy().view(np.uint32).astype(np.uint64) + np.uint64(1))
            sig = signatures(grams, ends[:-1] - ends[0], BANDS * ROWS).reshape(batch.num_rows, BANDS, ROWS).astype(np.uint64)
            band = kernel.mix(salt[None, :] + batch.column(1).to_numpy().view(np.uint64)[:, None])
            for r in range(ROWS):
                band = kernel.mix(band * np.uint64(0x9FB21C651E98DF25) + sig[:, :, r])
            bands = pa.FixedSizeListArray.from_arrays(pa.array(kernel.signed(band.ravel())), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), lists, bands], names=["node", "rank", "grams", "bands"])

    return nodes.select("node", "src", "rank", "grams").mapInArrow(run, "node long, rank long, grams array<int>, bands array<long>")


def star_clusters(nodes: DataFrame, similar: float, paired: int = PAIRED) -> DataFrame:
    """(node, cluster): which leader each node of nodes (node, rank, grams, bands) joined; nodes that joined none are left out.

    Nodes are linked if they share a bucket and are similar enough. A node leads if no linked node of higher rank does;
    every other node joins the most similar of the linked leaders of higher rank (of equally similar ones that of the
    greater id). Nothing of this depends on ``paired``, which only says how links are found: in buckets of up to so
    many nodes all pairs are verified. Larger ones are cut losslessly first (``_cut``). Then, in rounds, nodes that stand
    first in all their buckets lead for good, and the nodes linked to them are taken out, so that very many variants of
    one line are never paired off with each other. Where rounds take out little, all pairs of what is left are verified.
    """
    exact_unions(nodes.sparkSession)
    in_band = nodes.select("node", "rank", F.explode("bands").alias("band"))
    counts = materialize(in_band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "line-buckets")
    shared = materialize(in_band.join(_small(counts.select("band")), "band"), "line-shared")
    # from here on only nodes that share a bucket count
    sharing = materialize(shared.select("node").distinct(), "line-sharing")
    grams = materialize(nodes.select("node", "grams").join(_small(sharing), "node", "left_semi"), "line-grams")
    leaders: list[DataFrame] = []
    gone: list[DataFrame] = []
    full = counts.where(F.col("n") > paired).select("band")
    if full.take(1):
        shared = materialize(_cut(shared, full, grams, similar), "line-cut")
    whole, before = shared, None
    while True:
        sizes = shared.groupBy("band").agg(F.count("*").alias("n")).where(F.col("n") > paired)
        pairs = sizes.agg(F.sum(F.col("n").cast("double") * (F.col("n") - 1) / 2)).first()[0] if before is not None or full.take(1) else None
        if not pairs or before is not None and pairs > PAYS * before:
            break
        before = pairs
        first = shared.groupBy("band").agg(F.max(F.struct("rank", "node")).alias("first")).select("band", F.col("first.node").alias("lead"))
        edges = materialize(shared.join(first, "band").where("node != lead").select("node", "lead").distinct(), "line-edges")
        free = materialize(edges.join(edges.select(F.col("node").alias("lead")).distinct(), "lead", "left_anti").select("node", "lead"), "line-free")
        leaders.append(free.select(F.col("lead").alias("node")).distinct())
        gone.append(materialize(_similar(free, grams, similar).select("node").distinct(), "line-gone"))
        shared = materialize(shared.join(leaders[-1].unionByName(gone[-1]), "node", "left_anti"), "line-shared")

    linked = materialize(_similar(_pairs(shared, shared), grams, similar), "line-links")
    links = linked
    while links.take(1):
        leaders.append(materialize(links.select(F.col("lead").alias("node")).join(links.select("node"), "node", "left_anti").distinct(), "line-leaders"))
        led = materialize(links.join(leaders[-1].withColumnRenamed("node", "lead"), "lead", "left_semi").select("node").distinct(), "line-led")
        links = materialize(links.join(led, "node", "left_anti").join(led.withColumnRenamed("node", "lead"), "lead", "left_anti"), "line-links")
    if not leaders:
        return nodes.select("node", F.col("node").alias("cluster")).limit(0)
    lead = functools.reduce(DataFrame.unionByName, leaders)
    linked = linked.join(lead.withColumnRenamed("node", "lead"), "lead", "left_semi").select("node", "lead", "similarity")
    if gone:
        # what the rounds took out may be more like leaders that were found later
        out = materialize(functools.reduce(DataFrame.unionByName, gone), "line-gone")
        linked = linked.unionByName(_similar(_pairs(whole.join(out, "node", "left_semi"), whole.join(lead, "node", "left_semi")), grams, similar))
    return linked.groupBy("node").agg(F.max(F.struct("similarity", "lead")).alias("best")).select("node", F.col("best.lead").alias("cluster"))


def _cut(shared: DataFrame, full: DataFrame, grams: DataFrame, similar: float) -> DataFrame:
    """(node, rank, band) of shared, with the buckets ``full`` cut by the rarest grams of their nodes.

    Of two sets that are similar enough, each has one of the other's among its ``size - similar * size + 1`` rarest grams,
    so that the two meet again in a part of each bucket that they shared.
    """
    met = shared.join(full, "band", "left_semi")
    held = materialize(grams.join(met.select("node").distinct(), "node", "left_semi").select("node", F.size("grams").alias("size"), F.explode("grams").alias("gram")), "line-held")
    place = F.row_number().over(Window.partitionBy("node").orderBy("n", "gram"))
    rarest = held.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram").withColumn("place", place).where(F.col("place") <= F.col("size") - F.ceil(F.col("size") * similar - 1e-6) + 1)
    parts = met.join(rarest.select("node", "gram"), "node").select("node", "rank", F.xxhash64("band", "gram").alias("band"))
    return shared.join(full, "band", "left_anti").select("node", "rank", "band").unionByName(parts)


def _pairs(some: DataFrame, leads: DataFrame) -> DataFrame:
    """(node, lead): nodes of some (node, rank, band) with those of leads that share a bucket and are of higher rank."""
    a, b = (x.select("band", F.col("node").alias(n), F.col("rank").alias(f"{n}_rank")) for x, n in ((some, "node"), (leads, "lead")))
    return a.join(b, "band").where(F.struct("lead_rank", "lead") > F.struct("node_rank", "node")).select("node", "lead").distinct()


def _similar(pairs: DataFrame, grams: DataFrame, similar: float) -> DataFrame:
    """(node, lead, similarity) of the pairs (node, lead) whose sets of grams (node, grams) are similar enough."""
    both = pairs.select("node", "lead").join(grams, "node").join(grams.select(F.col("node").alias("lead"), F.col("grams").alias("other")), "lead")
    # products of the bound are not exact: 0.8 x 35 is a little over 28
    both = both.where(F.least(F.size("grams"), F.size("other")) + 1e-6 >= similar * F.greatest(F.size("grams"), F.size("other")))
    both = both.withColumn("common", F.size(F.array_intersect("grams", "other")))
    return both.withColumn("similarity", F.col("common") / (F.size("grams") + F.size("other") - F.col("common"))).where(F.col("similarity") >= similar).select("node", "lead", "similarity")


def _small(keys: DataFrame) -> DataFrame:
    """A written table of keys, to be broadcast if these are few."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def repeated_lines(
    records: DataFrame,
    documents: DataFrame,
    id_col: str = "chunk_id",
    doc_col: str = "document_id",
    text_col: str = "text",
    doc_id: str = "doc_id",
    source_col: str = "service_name",
    min_documents: int = MIN_DOCUMENTS,
    min_letters: int = MIN_LETTERS,
    similar: float = SIMILAR,
) -> DataFrame:
    """(id, line_no, source, cluster, cluster_documents, line_documents): the occurrences of the lines of each cluster
    that stands in at least ``min_documents`` documents of its source; line_documents counts those that hold this very line."""
    sources = documents.select(F.col(doc_id).alias("doc"), F.col(source_col).alias("source")).where("source IS NOT NULL")
    lines = line_forms(records, id_col, doc_col, text_col, min_letters).join(sources, "doc")
    found = materialize(lines.select("id", "line_no", "doc", "source", F.xxhash64("source", "letters").alias("node"), "grams"), "lines")

    # a node's rank: its occurrences first, then a part of its hash
    rank = F.shiftleft(F.least(F.count("*"), F.lit((1 << 19) - 1)), 43).bitwiseOR(F.col("node").bitwiseAND((1 << 43) - 1))
    nodes = found.where(F.size("grams") > 0).groupBy("node").agg(F.min(F.xxhash64("source")).alias("src"), F.min("grams").alias("grams"), rank.alias("rank"))
    nodes = nodes.withColumn("grams", F.array_distinct("grams"))
    members = star_clusters(materialize(with_bands(nodes), "line-nodes"), similar)

    placed = found.select("id", "line_no", "doc", "source", "node").join(members, "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
    often = placed.select("cluster", "doc").distinct().groupBy("cluster").agg(F.count("*").alias("cluster_documents")).where(F.col("cluster_documents") >= min_documents)
    # only here, inside the clusters that stay, the very same lines are told apart and counted
    kept = materialize(placed.join(often, "cluster"), "line-clusters")
    of_line = kept.select("node", "doc").distinct().groupBy("node").agg(F.count("*").alias("line_documents"))
    return kept.join(of_line, "node").select("id", "line_no", "source", "cluster", "cluster_documents", "line_documents")


def without_repeated(records: DataFrame, repeated: DataFrame, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The records with the lines of ``repeated`` taken out; ``lines_removed`` counts them. Other columns stay as they are."""
    gone = repeated.groupBy(F.col("id").alias(id_col)).agg(F.collect_set("line_no").alias("_gone"))
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n', -1), (x, i) -> NOT array_contains(_gone, i)), '\\n')")
    return records.join(gone, id_col, "left").withColumn(text_col, F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(kept)).withColumn("lines_removed", F.coalesce(F.size("_gone"), F.lit(0))).drop("_gone")
