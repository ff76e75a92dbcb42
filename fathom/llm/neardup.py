"""Near-duplicate records: groups of texts that share most of their word shingles.

Method: sequential Bayesian verification. Minhash signatures are cut into bands; texts
that agree in a whole band are candidates; their signatures are compared batch by batch,
and a pair is dropped as soon as the posterior chance that its similarity reaches the
threshold falls below the miss probability; survivors are verified on their shingle sets.

A word is a longest run of letters and digits (Unicode), in lower case; the similarity of
two texts is the Jaccard index of their sets of runs of consecutive words.

Texts of the same words in the same order make one class and are sketched as one. Bands
that too many classes share (``max_bucket``) are not paired off: their classes are joined
exactly instead, by the prefixes of their shingles ordered by rarity.

Defined results: rows of null id and texts that are null, empty or under ``min_words`` words take part in
nothing; rows that repeat an id count once; copies are linked among each other up to
``expand_copies`` rows of the very same text, beyond that each with its representative (the
least id), while ``duplicate_groups`` counts all links; texts that differ in anything are
linked each by itself; empty tables give empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.llm import kernel
from fathom.session import exact_unions, materialize

#: Fixed by the defaults: 50 bands of 4 rows find a pair of similarity 0.6 with chance 0.999 and one of 0.7 with 0.999999.
BANDS, ROWS = 50, 4
MISS = 1e-4
BATCH = 20
MAX_BUCKET = 64
EXPAND_COPIES = 1000
#: Ids to re-read are broadcast up to this number (8 bytes each); beyond it the texts are joined by shuffle.
BROADCAST_IDS = 1 << 20


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_601)
    a, b = rng.integers(0, 1 << 32, (2, n), dtype=np.uint64)
    return (a | np.uint64(1)).astype(np.uint32), (b | np.uint64(1)).astype(np.uint32)


def signatures(shingle: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """Minhashes (texts by n) of shingle hashes in runs that begin at ``begin``; no run may be empty."""
    low, high = shingle.astype(np.uint32), (shingle >> np.uint64(32)).astype(np.uint32)
    a, b = _coefficients(n)
    out, x, y = np.empty((n, len(begin)), np.uint32), np.empty_like(low), np.empty_like(low)
    for k in range(n):
        np.multiply(low, a[k], out=x)
        np.multiply(high, b[k], out=y)
        x += y
        out[k] = np.minimum.reduceat(x, begin)
    return out.T.copy()


def sequence_hashes(w: kernel.Words, n: int) -> np.ndarray:
    """A 64-bit hash of the words of each text in their order."""
    splits = np.searchsorted(w.doc, np.arange(n + 1))
    up, down = kernel._powers(max(20, int(len(w.hash)).bit_length()))
    total = np.zeros(len(w.hash) + 1, np.uint64)
    np.cumsum(w.hash * up[: len(w.hash)], out=total[1:])
    return kernel.mix((total[splits[1:]] - total[splits[:-1]]) * down[splits[:-1]] + np.diff(splits).astype(np.uint64))


class _Sketched:
    """Texts of a block that take part: their rows, classes and shingles."""

    def __init__(self, texts: list[str | None], shingle: int, min_words: int) -> None:
        w = kernel.words(texts)
        counts = np.bincount(w.doc, minlength=len(texts))
        self.rows = np.flatnonzero(counts >= max(min_words, shingle))
        self.classes = sequence_hashes(w, len(texts))[self.rows]
        h, first = kernel.shingles(w, shingle)
        doc = w.doc[first]
        wanted = np.zeros(len(texts), bool)
        wanted[self.rows] = True
        keep = wanted[doc]
        self.hash, doc = h[keep], doc[keep]
        self.begin = np.searchsorted(doc, self.rows)


def sketch(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int, bands: int, rows: int) -> DataFrame:
    """(id, class, keys, same): the class of each text that takes part, and the key of each band of its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = kernel.mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernel.blocks(texts):
                s = _Sketched(texts[lo:hi], shingle, min_words)
                if not len(s.rows):
                    continue
                sig = signatures(s.hash, s.begin, bands * rows).reshape(len(s.rows), bands, rows).astype(np.uint64)
                key = np.broadcast_to(salt, sig.shape[:2]).copy()
                for r in range(rows):
                    key = kernel.mix(key * np.uint64(0x9FB21C651E98DF25) + sig[:, :, r])
                keys = pa.FixedSizeListArray.from_arrays(pa.array(kernel.signed(key.ravel())), bands)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(lo + s.rows)), pa.array(kernel.signed(s.classes)), keys.cast(pa.list_(pa.int64())), batch.column(2).take(pa.array(lo + s.rows))], names=["id", "class", "keys", "same"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("same")).where((F.length("text") > 0) & F.col("id").isNotNull()).mapInArrow(run, f"id {kind}, class long, keys array<long>, same long")


def shingle_sets(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int, hashes: int) -> DataFrame:
    """(class, signature, shingles): 16 bits of each minhash, and the sorted set of shingle hashes, of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in kernel.blocks(texts):
                s = _Sketched(texts[lo:hi], shingle, min_words)
                if not len(s.rows):
                    continue
                sig = signatures(s.hash, s.begin, hashes).astype(np.uint16)
                sets = [np.unique(x) for x in np.split(kernel.signed(s.hash), s.begin[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(kernel.signed(s.classes)), pa.array([x.tobytes() for x in sig], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["class", "signature", "shingles"])

    return df.select(id_col, text_col).mapInArrow(run, "class long, signature binary, shingles array<long>")


def least_matches(threshold: float, miss: float, hashes: int, batch: int) -> list[tuple[int, int]]:
    """After how many hashes how many must agree, for the posterior chance of reaching the threshold to stay over ``miss``.

    With a uniform prior the posterior of the similarity after m of n agreements is
    Beta(m + 1, n - m + 1), and its mass over t is the chance of at most m successes in
    n + 1 trials of chance t.
    """
    out = []
    for n in range(batch, hashes + 1, batch):
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append((n, m))
    return out


def prune(pairs: DataFrame, threshold: float, miss: float, hashes: int, batch: int = BATCH) -> DataFrame:
    """Pairs (a, b) of the rows (a, b, sig_a, sig_b) whose posterior never fell below ``miss``."""
    least = least_matches(threshold, miss, hashes, batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            left = np.arange(got.num_rows)
            x, y = (np.frombuffer(b"".join(got.column(c).to_pylist()), np.uint16).reshape(-1, hashes) for c in (2, 3))
            agree, done = np.zeros(got.num_rows, np.int32), 0
            for n, m in least:
                agree[left] += (x[left, done:n] == y[left, done:n]).sum(1)
                left, done = left[agree[left] >= m], n
            at = pa.array(left)
            yield pa.RecordBatch.from_arrays([got.column(0).take(at), got.column(1).take(at)], names=["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the class pairs whose sets of shingles reach the threshold."""
    one = sets.select("class", "shingles")
    return (
        pairs.join(one.select(F.col("class").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(one.select(F.col("class").alias("b"), F.col("shingles").alias("sb")), "b")
        .where(F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb")))
        .withColumn("both", F.size(F.array_intersect("sa", "sb")))
        .withColumn("similarity", F.col("both") / (F.size("sa") + F.size("sb") - F.col("both")))
        .where(F.col("similarity") >= threshold)
        .select("a", "b", "similarity")
    )


def prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of classes that share a shingle of their prefixes: every pair that reaches the threshold is among them.

    A set's prefix holds its rarest shingles, one more than it may miss. The sizes of both
    sets and the places of the shared shingle bound the overlap that is left.
    """
    flat = sets.select("class", F.size("shingles").alias("n"), F.explode("shingles").alias("g"))
    rarity = flat.groupBy("g").agg(F.count("*").alias("f")).where("f > 1")
    # shingles of one class only can be shared by no pair, and come first in every order: they use up prefix places
    lone = F.col("n") - F.col("kept")
    ranked = (
        flat.join(rarity, "g")
        .withColumn("kept", F.count("*").over(Window.partitionBy("class")))
        .withColumn("place", lone + F.row_number().over(Window.partitionBy("class").orderBy("f", "g")))
        .where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1)
        .select("class", "n", "g", "place")
    )
    a, b = (ranked.select("g", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "place"))) for s in "ab")
    need = F.ceil((F.col("n_a") + F.col("n_b")) * (threshold / (1 + threshold)) - 1e-9)
    return (
        a.join(b, "g")
        .where("class_a < class_b")
        .where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
        .where(1 + F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + F.least(F.col("place_a"), F.col("place_b")) - 1 >= need)
        .select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
        .distinct()
    )


class NearDuplicates:
    """Near-duplicate search over one table; ``members`` and ``links`` are tables in the shared folder."""

    def __init__(
        self, df: DataFrame, id_col: str = "chunk_id", text_col: str = "text", shingle: int = 5, threshold: float = 0.8, min_words: int = 0, bands: int = BANDS, rows: int = ROWS, miss: float = MISS, max_bucket: int = MAX_BUCKET, expand_copies: int = EXPAND_COPIES
    ) -> None:
        exact_unions(df.sparkSession)
        self.expand_copies = expand_copies
        sketches = materialize(sketch(df, id_col, text_col, shingle, min_words, bands, rows), "sketches")
        # ``same`` is equal for texts that are equal character for character
        self.members = sketches.groupBy("id").agg(F.min(F.struct("class", "same")).alias("m")).select("id", "m.class", "m.same")
        # Keys are counted before rows are joined to the counts: the count combines before its shuffle, and a key that
        # a third of all rows have is split in the join. Copies count here too and fall out of the distinct rows.
        bands_of = sketches.select(F.explode("keys").alias("key"), "class")
        met = bands_of.join(bands_of.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").select("key"), "key").distinct()
        met = materialize(met, "met")
        shared = materialize(met.join(met.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "buckets")
        small, hot = shared.where(F.col("n") <= max_bucket), shared.where(F.col("n") > max_bucket).select("class").distinct()
        pairs = small.select("key", F.col("class").alias("a")).join(small.select("key", F.col("class").alias("b")), "key").where("a < b").select("a", "b").distinct()

        # the texts of one member of each class that has a candidate are read again
        read = self.members.join(shared.select("class").distinct(), "class", "left_semi").groupBy("class").agg(F.min("id").alias(id_col)).select(id_col)
        read = materialize(read, "read-again")
        few = read.count() <= BROADCAST_IDS
        texts = df.select(id_col, text_col).join(F.broadcast(read) if few else read, id_col, "left_semi")
        sets = materialize(shingle_sets(texts, id_col, text_col, shingle, min_words, bands * rows).dropDuplicates(["class"]), "sets")

        sig = sets.select("class", "signature")
        both = pairs.join(sig.select(F.col("class").alias("a"), F.col("signature").alias("sig_a")), "a").join(sig.select(F.col("class").alias("b"), F.col("signature").alias("sig_b")), "b")
        found = prune(both, threshold, miss, bands * rows)
        if hot.take(1):
            found = found.unionByName(prefix_pairs(sets.join(hot, "class", "left_semi"), threshold)).distinct()
        self.links = materialize(verify(found, sets, threshold), "links")

    def pairs(self) -> DataFrame:
        """(a, b) with a < b: linked ids, copies included as the module's docstring says."""
        sized = self.members.groupBy("class", "same").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
        crowd = sized.where(F.col("copies") > self.expand_copies).select("class", "same", "head")
        # a crowd of the very same text stands for itself by its head in links to other texts, those of its class too
        nodes = self.members.join(crowd, ["class", "same"], "left").where("head IS NULL OR id = head").select("id", "class")
        left, right = nodes.select(F.col("id").alias("x"), F.col("class").alias("a")), nodes.select(F.col("id").alias("y"), F.col("class").alias("b"))
        between = self.links.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
        copied = nodes.join(nodes.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class"), "class", "left_semi")
        within = copied.select("class", F.col("id").alias("x")).join(copied.select("class", F.col("id").alias("y")), "class").where("x < y").select("x", "y")
        crowded = self.members.join(crowd, ["class", "same"]).where("id != head").select(F.col("head").alias("x"), F.col("id").alias("y"))
        return between.unionByName(within).unionByName(crowded).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def groups(self) -> DataFrame:
        """(id, group_id, group_size, copies, links, same_as): one row per id that takes part. group_id is the group's least id;
        copies counts ids of the same words, links the ids linked to this one, all copies included. same_as is the least id
        of the very same text: where ``pairs`` names only that one of a crowd, the others' pairs follow by joining it."""
        sized = self.members.groupBy("class").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
        ends = self.links.select("a", "b").unionByName(self.links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        degree = ends.join(sized.select(F.col("class").alias("b"), "copies"), "b").groupBy(F.col("a").alias("class")).agg(F.sum("copies").alias("across"))
        component = connected_components(self.links.select("a", "b"))
        labelled = sized.join(component.select(F.col("node").alias("class"), "component"), "class", "left").join(degree, "class", "left").withColumn("component", F.coalesce("component", "class"))
        of_group = labelled.groupBy("component").agg(F.min("head").alias("group_id"), F.sum("copies").alias("group_size"))
        classes = labelled.join(of_group, "component").select("class", "group_id", "group_size", "copies", (F.col("copies") - 1 + F.coalesce("across", F.lit(0))).alias("links"))
        heads = self.members.groupBy("class", "same").agg(F.min("id").alias("same_as"))
        return self.members.join(heads, ["class", "same"]).join(classes, "class").select("id", "group_id", "group_size", "copies", "links", "same_as")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component) of an undirected graph (a, b): the least node that each node reaches.

    Alternating large-star and small-star rounds, which need a number of rounds that grows
    as the logarithm of the longest path; each round is written to the shared folder.
    """
    exact_unions(edges.sparkSession)
    now = materialize(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(max_rounds):
        ways = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        heads = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(heads, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        after = materialize(small, "cc")
        same = after.count() == now.count() and not after.join(now, ["u", "v"], "left_anti").take(1)
        now = after
        if same:
            break
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
