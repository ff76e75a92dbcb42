"""Most similar vectors for every vector.

Method: additive quantisation. A vector is approximated by a sum of full-dimensional
codewords, one of each codebook; codes are found by beam search, the codebooks by
alternating encoding and joint least squares on a bounded sample. The first code names a
list, however many vectors there are; a vector is stored in the lists of its best beams,
which are found among all lists or, of very many, in the nearest groups of lists.
A query goes to the lists of its best beams; there, tables of its inner products with all
codewords and the stored norms score the codes, and the best scores are reranked on the
exact vectors.

Every row is indexed. Ids are integers. Defined results: rows of null id and vectors that
are null, of another dimension, zero or not finite take part in nothing; length plays no
role; rows that repeat an id count once; of equal similarities the lesser id is nearer;
copies of a vector are indexed once and find each other at similarity 1; empty tables give
empty tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.session import exact_unions, materialize

#: Rows that the residual codebooks are fitted on, at most; rows that each list's centre is fitted on, at least, once there are more.
FIT_ROWS, ROWS_A_LIST = 1 << 15, 8
#: Rows of the sample that are encoded at once on the driver.
FIT_STEP = 2048
#: Residual codebooks and their codewords, beams of the encoder.
BOOKS, WORDS, BEAMS = 6, 256, 4
#: Vectors of a list, on average; lists, at most (with more vectors lists grow longer); vectors and queries of one task's block, at most.
LIST_ROWS, MAX_LISTS, BLOCK_ROWS, BLOCK_QUERIES = 1000, 1 << 16, 8192, 1 << 16
#: Lists up to this number are all compared with a vector; of more, those in the groups of lists nearest to it. Groups that are looked into, at least.
FLAT_LISTS, LEAST_GROUPS = 4096, 16
#: Bytes of packed queries that ``search`` may broadcast.
BROADCAST_BYTES = 64 << 20
#: Lists that a row is stored in; scores that are reranked in each list.
SPILLS, SHORTLIST = 3, 96
#: For neighbours of similarity 0.9 and more: 0.998 of them lie in these lists (measured on 277,862 vectors).
NEAR = {"list_rows": 500, "probes": 6, "spills": 2}
#: Candidates beyond those kept that are reranked in double precision.
SPARE = 6
#: Bytes of listed vectors that a task takes.
TASK_BYTES = 8 << 20


def _best(score: np.ndarray, keep: int) -> np.ndarray:
    """Places of the best scores of each row, best first. The scores are overwritten."""
    keep = min(keep, score.shape[1])
    if keep > 16:
        top = np.argpartition(-score, keep - 1, 1)[:, :keep] if keep < score.shape[1] else np.broadcast_to(np.arange(keep), score.shape)
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), 1, kind="stable"), 1)
    top, rows = np.empty((len(score), keep), np.int64), np.arange(len(score))
    for k in range(keep):  # a few searches for the maximum cost less than a partition
        top[:, k] = score.argmax(1)
        score[rows, top[:, k]] = -np.inf
    return top


def beam_encode(x: np.ndarray, books: list[np.ndarray], beams: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, beams, books) of the best sums found, best first, and their residuals."""
    n, d = x.shape
    codes = np.zeros((n, 1, 0), np.int32)
    left = x[:, None, :]
    for book in books:
        half = 0.5 * (book * book).sum(1)
        gain = left.reshape(-1, d) @ book.T - half  # half the decrease of the squared residual
        total = gain.reshape(n, left.shape[1], -1)
        total -= 0.5 * np.einsum("nbd,nbd->nb", left, left)[:, :, None]
        top = _best(total.reshape(n, -1), beams)
        parent, word = top // len(book), top % len(book)
        left = np.take_along_axis(left, parent[:, :, None], 1) - book[word]
        codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None].astype(np.int32)], 2)
    return codes, left


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    centre = x[rng.choice(len(x), k, len(x) < k)].copy()
    for _ in range(rounds):
        half = 0.5 * (centre * centre).sum(1)
        near = np.concatenate([(x[at : at + FIT_STEP] @ centre.T - half).argmax(1) for at in range(0, len(x), FIT_STEP)])
        order = np.argsort(near, kind="stable")
        count = np.bincount(near, minlength=k)
        full = np.flatnonzero(count)
        begin = np.concatenate([[0], np.cumsum(count)])[full]
        centre[full] = np.add.reduceat(x[order], begin, 0) / count[full, None]
    return centre


def encode_steps(x: np.ndarray, books: list[np.ndarray], beams: int) -> tuple[np.ndarray, np.ndarray]:
    """The best codes and their residuals, in steps of bounded memory."""
    parts = [[a[:, 0] for a in beam_encode(x[at : at + FIT_STEP], books, beams)] for at in range(0, len(x), FIT_STEP)]
    return np.concatenate([c for c, _ in parts]), np.concatenate([r for _, r in parts])


@dataclass
class Codebooks:
    """``books[0]`` has the lists' centres; the first code names a list."""

    books: list[np.ndarray]
    #: Where there are many lists: centres of groups of them, and where each group's lists begin.
    groups: np.ndarray | None = None
    begins: np.ndarray | None = None

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, seed: int = 7) -> Codebooks:
        rng = np.random.default_rng(seed)
        groups = begins = None
        if lists <= FLAT_LISTS:
            books = [kmeans(x, lists, rng)]
        else:
            groups = kmeans(x, math.isqrt(lists), rng)
            near = encode_steps(x, [groups], 1)[0][:, 0]
            mine = [x[near == g] for g in range(len(groups))]
            groups, mine = groups[[len(m) > 0 for m in mine]], [m for m in mine if len(m)]
            centres = [kmeans(m, max(1, round(lists * len(m) / len(x))), rng, 5) for m in mine]
            books, begins = [np.concatenate(centres)], np.cumsum([0, *map(len, centres)])
        made = cls(books, groups, begins)
        x = x[:FIT_ROWS]  # the sample is in no order that tells
        own = np.concatenate([made.cells(x[at : at + FIT_STEP], 1)[:, 0] for at in range(0, len(x), FIT_STEP)])
        inside = x - books[0][own]
        left = inside
        for _ in range(BOOKS):  # a single beam goes on from what the books before left
            books.append(kmeans(left, WORDS, rng, 5))
            left = encode_steps(left, books[-1:], 1)[1]
        # joint least squares of the residual codebooks; the lists' centres stay
        for _ in range(2):
            codes = np.concatenate([own[:, None], encode_steps(inside, books[1:], BEAMS)[0]], 1)
            target = inside
            # which codewords stand together how often, and the sum of the targets that each takes part in
            gram, pull = 0.5 * np.eye(BOOKS * WORDS), 0.5 * np.concatenate(books[1:]).astype(np.float64)
            for m in range(BOOKS):
                mine = codes[:, m + 1].astype(np.int64)
                order = np.argsort(mine, kind="stable")
                met = np.flatnonzero(np.bincount(mine, minlength=WORDS))
                pull[m * WORDS + met] += np.add.reduceat(target[order], np.searchsorted(mine[order], met), 0, np.float64)
                for n in range(BOOKS):
                    met = np.bincount(mine * WORDS + codes[:, n + 1], minlength=WORDS * WORDS)
                    gram[m * WORDS : (m + 1) * WORDS, n * WORDS : (n + 1) * WORDS] += met.reshape(WORDS, WORDS)
            solved = np.linalg.solve(gram, pull)
            books = [books[0], *np.split(solved.astype(np.float32), BOOKS)]
        made.books = books
        return made

    def cells(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The lists of the best beams of each vector, the best first."""
        if self.groups is None:
            return beam_encode(x, self.books[:1], probes)[0][:, :, 0]
        # beams over groups of lists, then over the lists of these groups; each group has one list at least
        probes = min(probes, len(self.books[0]))
        group = beam_encode(x, [self.groups], max(LEAST_GROUPS, probes))[0][:, :, 0]
        score = np.full((*group.shape, probes), -np.inf, np.float32)
        cell = np.zeros(score.shape, np.int32)
        order = np.argsort(group, axis=None, kind="stable")
        met, first = np.unique(group.ravel()[order], return_index=True)
        for g, places in zip(met.tolist(), np.split(order, first[1:])):
            row, slot = np.unravel_index(places, group.shape)
            centres = self.books[0][self.begins[g] : self.begins[g + 1]]
            near = x[row] @ centres.T - 0.5 * (centres * centres).sum(1)
            top = _best(near.copy(), probes)
            cell[row, slot, : top.shape[1]] = self.begins[g] + top
            score[row, slot, : top.shape[1]] = np.take_along_axis(near, top, 1)
        return np.take_along_axis(cell.reshape(len(x), -1), _best(score.reshape(len(x), -1), probes), 1)

    def encode(self, x: np.ndarray, probes: int, spills: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best lists of each vector, and for the first ``spills`` of them its codes of the residual codebooks and the norm of the approximation."""
        cells = self.cells(x, max(probes, spills))
        parts = [self._encode_in(x, cells[:, s]) for s in range(min(spills, cells.shape[1]))]
        return cells, np.stack([c for c, _ in parts], 1), np.stack([n for _, n in parts], 1)

    def _encode_in(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        codes, left = beam_encode(x - self.books[0][cell], self.books[1:], BEAMS)
        codes, left = codes[:, 0], left[:, 0]
        return codes.astype(np.uint8), np.linalg.norm(x - left, axis=1).astype(np.float32)


def search_block(books: Codebooks, q: np.ndarray, ids: np.ndarray, codes: np.ndarray, first: np.ndarray, norms: np.ndarray, vectors: np.ndarray, keep: int, shortlist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For queries q the best rows of a block: (query row, place in the block, exact similarity)."""
    out_q, out_d, out_s = [], [], []
    n, shortlist = len(ids), min(shortlist, len(ids))
    step = max(16, (1 << 19) // max(n, 1))
    centres, at = np.unique(first, return_inverse=True)
    scale = 1 / np.maximum(norms, 1e-6)
    for lo in range(0, len(q), step):
        part = q[lo : lo + step]
        score = (books.books[0][centres] @ part.T)[at]
        for m, book in enumerate(books.books[1:]):
            score += (book @ part.T)[codes[:, m]]  # table lookup: rows of the table, by code
        score *= scale[:, None]
        top = np.argpartition(-score, shortlist - 1, 0)[:shortlist].T if shortlist < n else np.broadcast_to(np.arange(n), (len(part), n))
        if top.shape[1] > keep + SPARE:  # single precision leaves a few more than are kept, double precision decides among them
            rough = np.matmul(vectors[top], part[:, :, None])[:, :, 0]
            top = np.take_along_axis(top, np.argpartition(-rough, keep + SPARE - 1, 1)[:, : keep + SPARE], 1)
        exact = np.einsum("qd,qrd->qr", part.astype(np.float64), vectors[top].astype(np.float64))
        order = np.lexsort((ids[top], -exact), axis=1)[:, :keep]
        out_q.append(np.repeat(np.arange(lo, lo + len(part)), order.shape[1]))
        out_d.append(np.take_along_axis(top, order, 1).ravel())
        out_s.append(np.take_along_axis(exact, order, 1).ravel())
    return np.concatenate(out_q), np.concatenate(out_d), np.concatenate(out_s)


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, same, vector): unit vectors as 4-byte floats; ``same`` is equal for copies of a vector."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            good = np.isfinite(x).all(1) & (x != 0).any(1)
            x = x[good]
            x /= np.abs(x).max(1, keepdims=True, initial=0)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([v.tobytes() for v in x.astype(np.float32)], pa.binary())], names=["id", "same", "vector"])

    picked = df.select(F.col(id_col).alias("id"), F.xxhash64(vector_col).alias("same"), F.col(vector_col).alias("vector")).where((F.size("vector") == dim) & F.col("id").isNotNull())
    return picked.mapInArrow(run, f"id {kind}, same long, vector binary")


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int, dtype: type = np.float32) -> np.ndarray:
    """The packed rows of a binary column without nulls, as they lie in its buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.binary())
    if not len(column):
        return np.empty((0, dim), dtype)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(-1, dim)


def probes_for(lists: int) -> int:
    """Lists that a query goes to so that ``similar`` finds 0.9 of all true neighbours, near or far, and not only of the near ones.

    Measured on vectors of 64 dimensions with rows in three lists of 1000: 6 of 28 lists and 13 of 277 are enough.
    """
    return max(6, round(1.8 * lists**0.35))


class VectorIndex:
    """Additive-quantisation index over one table of vectors.

    The defaults are for all k nearest of every vector. Who asks only for near ones (``similar`` with a high ``least``)
    does with the NEAR settings: shorter lists, fewer of them.
    """

    def __init__(self, df: DataFrame, id_col: str = "chunk_id", vector_col: str = "embedding", dim: int = 64, fit_rows: int = FIT_ROWS, list_rows: int | None = None, probes: int | None = None, spills: int = SPILLS) -> None:
        exact_unions(df.sparkSession)
        self.dim, self.spills, self.id_type = dim, spills, df.schema[id_col].dataType.simpleString()
        self.all = materialize(usable(df, id_col, vector_col, dim), "vectors")
        self.copies = materialize(self.all.groupBy("same").agg(F.countDistinct("id").alias("n"), F.min("id").alias("head")).where("n > 1"), "copies")
        self.has_copies = bool(self.copies.take(1))
        self.alone = self.all
        if self.has_copies:  # of each group of copies only the head is indexed
            self.alone = self.all.join(self.copies, "same", "left").where("head IS NULL OR id = head").select("id", "same", "vector")
        total = self.total = self.all.count()
        lists = int(np.clip(total // (list_rows or LIST_ROWS), 1, MAX_LISTS))
        fit_rows = max(fit_rows, ROWS_A_LIST * lists if lists > FLAT_LISTS else 0)
        share = min(1 << 30, int(fit_rows / max(total, 1) * (1 << 30)))
        sample = self.all.where((F.xxhash64(F.lit("fit"), "id").bitwiseAND((1 << 30) - 1)) <= share).select("vector").limit(fit_rows).toArrow()
        self.probes = max(probes or probes_for(lists), spills)
        self.books = Codebooks.fit(_matrix(sample.column(0), dim), lists) if sample.num_rows else None
        self.indexed = materialize(self._encode(), "indexed")

    def _encode(self) -> DataFrame:
        books, dim, probes, spills = self.books, self.dim, self.probes, self.spills

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def lists(values: pa.Array, width: int) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(np.arange(len(values) // width + 1, dtype=np.int32) * width), values)

            for batch in batches:
                for at in range(0, batch.num_rows, 2048):
                    part = batch.slice(at, 2048)
                    cell, code, norm = books.encode(_matrix(part.column(1), dim), probes, spills)
                    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(BOOKS), code.shape[0] * code.shape[1], [None, pa.py_buffer(np.ascontiguousarray(code))]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), lists(pa.array(cell.ravel(), pa.int32()), cell.shape[1]), lists(packed, code.shape[1]), lists(pa.array(norm.ravel()), code.shape[1]), part.column(1)], names=["id", "cells", "codes", "norms", "vector"])

        return self.alone.select("id", "vector").mapInArrow(run, f"id {self.id_type}, cells array<int>, codes array<binary>, norms array<float>, vector binary")

    def _stored(self, every: bool) -> DataFrame:
        """(id, cell, code, norm, vector): a row for each list that a vector is stored in, or for its best one."""
        if every:
            return self._listed().where("code IS NOT NULL").select("id", "cell", "code", "norm", "vector")
        return self.indexed.select("id", F.get("cells", F.lit(0)).alias("cell"), F.get("codes", F.lit(0)).alias("code"), F.get("norms", F.lit(0)).alias("norm"), "vector")

    def _listed(self) -> DataFrame:
        """(id, cell, code, norm, vector): a row for each list that a vector goes to as a query; in the first ones it is stored as well and has a code."""
        placed = self.indexed.select("id", "codes", "norms", "vector", F.posexplode("cells").alias("nth", "cell"))
        return placed.select("id", "cell", F.get("codes", "nth").alias("code"), F.get("norms", "nth").alias("norm"), "vector")

    def similar(self, k: int = 5, least: float = -1.0, shortlist: int = SHORTLIST) -> DataFrame:
        """(id, neighbour, similarity, rank): the k nearest of every indexed vector, of at least similarity ``least``.

        Queries are all indexed rows. A vector travels once to each of its lists, in the first of which it is stored, too.
        Lists longer than a block are split, and so are their queries: each task sees one block of each.
        """
        books, dim = self.books, self.dim

        def block(table):
            right = table.filter(table.column("stored"))
            left = table.filter(table.column("asks"))
            if not left.num_rows or not right.num_rows:
                none = table.column("id").slice(0, 0)
                return pa.table({"id": none, "neighbour": none, "similarity": pa.array([], pa.float64())})
            ids, cell = right.column("id").to_numpy(), right.column("cell").to_numpy()
            q, d, s = search_block(books, _matrix(left.column("vector"), dim), ids, _matrix(right.column("code"), BOOKS, np.uint8), cell, right.column("norm").to_numpy(), _matrix(right.column("vector"), dim), k + 1, shortlist)
            own, near = left.column("id").to_numpy()[q], ids[d]
            good = (s >= least) & (own != near)
            own, near, s = own[good], near[good], s[good]
            # what one side's lists missed the other side's may have found: both directions leave the block
            return pa.table({"id": np.concatenate([own, near]), "neighbour": np.concatenate([near, own]), "similarity": np.concatenate([s, s])})

        rows = self._listed()
        sizes = rows.groupBy("cell").agg(F.count("code").alias("n"), F.count("*").alias("q"))
        big = sizes.where((F.col("n") > BLOCK_ROWS) | (F.col("q") > BLOCK_QUERIES))
        big = materialize(big.select("cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("parts"), F.ceil(F.col("q") / BLOCK_QUERIES).cast("int").alias("turns")), "big-lists")
        stored = F.col("code").isNotNull()
        if big.take(1):
            split = rows.join(big, "cell", "left").fillna(1, ["parts", "turns"]).withColumn("h", F.xxhash64("id"))
            one, no, yes = F.lit(1), F.lit(False), F.lit(True)
            # a stored row meets every turn of queries in its own part, a query every part in its own turn
            as_row = F.transform(F.sequence(F.lit(0), F.col("turns") - 1), lambda t: F.struct(F.pmod("h", F.greatest("parts", one)).cast("int").alias("part"), t.alias("turn"), yes.alias("stored"), no.alias("asks")))
            as_query = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.pmod("h", F.col("turns")).cast("int").alias("turn"), no.alias("stored"), yes.alias("asks")))
            split = split.withColumn("parts", F.greatest("parts", one))
            rows = split.select("id", "cell", "code", "norm", "vector", F.inline(F.concat(F.when(stored, as_row).otherwise(F.filter(as_row, lambda _: no)), as_query)))
        else:
            rows = rows.select("*", F.lit(0).alias("part"), F.lit(0).alias("turn"), stored.alias("stored"), F.lit(True).alias("asks"))
        # tasks of a bounded size, however large the collection is
        tasks = max(1, -(-self.total * self.probes * (4 * dim + 40) // TASK_BYTES))
        rows = rows.repartition(max(tasks, rows.sparkSession.sparkContext.defaultParallelism), "cell", "part", "turn")
        found = rows.groupBy("cell", "part", "turn").applyInArrow(block, f"id {self.id_type}, neighbour {self.id_type}, similarity double")
        return self._ranked(self._spread(found, k) if self.has_copies else found, k, least)

    def search(self, queries: DataFrame, k: int = 5, shortlist: int = 192) -> DataFrame:
        """(id, neighbour, similarity, rank): the k nearest rows of each query row (id, vector), scoring the codes of all rows.

        For a stated set of queries: packed blocks of queries meet packed blocks of rows. Queries of up to
        ``BROADCAST_BYTES`` go to all tasks; beyond that, partitions meet pairwise.
        """
        books, dim, has_copies = self.books, self.dim, self.has_copies

        def pack(columns: tuple[str, ...], rows: int):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for at in range(0, batch.num_rows, rows):
                        part = batch.slice(at, rows)
                        packed = [part.column(c).to_numpy(zero_copy_only=False).tobytes() if c in ("id", "cell", "norm") else b"".join(part.column(c).to_pylist()) for c in columns]
                        yield pa.RecordBatch.from_arrays([pa.array([p], pa.binary()) for p in packed], names=list(columns))

            return run

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    qid, qv, ids, cell, code, norm, vec = (batch.column(c)[r].as_buffer() for c in range(7))
                    qid, ids = np.frombuffer(qid, np.int64), np.frombuffer(ids, np.int64)
                    q, d, s = search_block(books, np.frombuffer(qv, np.float32).reshape(-1, dim), ids, np.frombuffer(code, np.uint8).reshape(-1, BOOKS), np.frombuffer(cell, np.int32), np.frombuffer(norm, np.float32), np.frombuffer(vec, np.float32).reshape(-1, dim), k + 1, shortlist)
                    good = (qid[q] != ids[d]) | has_copies  # a query that heads copies leads to them by itself
                    yield pa.RecordBatch.from_arrays([pa.array(qid[q][good]), pa.array(ids[d][good]), pa.array(s[good])], names=["id", "neighbour", "similarity"])

        asked = queries.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(pack(("id", "vector"), 1024), "id binary, vector binary").toDF("qid", "qv")
        stored = self._stored(False).withColumn("id", F.col("id").cast("long")).mapInArrow(pack(("id", "cell", "code", "norm", "vector"), BLOCK_ROWS), "id binary, cell binary, code binary, norm binary, vector binary")
        asked = materialize(asked, "query-blocks")
        size = asked.agg(F.sum(F.length("qid") + F.length("qv"))).first()[0] or 0
        met = stored.crossJoin(F.broadcast(asked)).select("qid", "qv", "id", "cell", "code", "norm", "vector") if size <= BROADCAST_BYTES else asked.crossJoin(stored)
        found = met.mapInArrow(meet, "id long, neighbour long, similarity double")
        found = found.select(F.col("id").cast(self.id_type).alias("id"), F.col("neighbour").cast(self.id_type).alias("neighbour"), "similarity")
        return self._ranked(self._to_copies(found, k)[0] if self.has_copies else found, k, -1.0)

    def _ranked(self, found: DataFrame, k: int, least: float) -> DataFrame:
        best = found.where((F.col("similarity") >= least) & (F.col("id") != F.col("neighbour"))).groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
        order = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
        return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _to_copies(self, found: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Rows with each neighbour that heads a group of copies replaced by the group's k + 1 least ids; all members; those ids."""
        members = self.all.join(self.copies.select("same", "head"), "same").select("head", "id").distinct()
        first = members.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).where(F.col("r") <= k + 1).drop("r")
        replaced = found.join(first.select(F.col("head").alias("neighbour"), F.col("id").alias("copy")), "neighbour", "left").select("id", F.coalesce("copy", "neighbour").alias("neighbour"), "similarity")
        return replaced, members, first

    def _spread(self, found: DataFrame, k: int) -> DataFrame:
        """The neighbours of each head of copies given to all its copies, which are neighbours of each other too."""
        found, members, first = self._to_copies(found, k)
        heads = members.select(F.col("head").alias("id"), F.col("id").alias("copy"))
        spread = found.join(heads, "id", "left").select(F.coalesce("copy", "id").alias("id"), "neighbour", "similarity")
        among = members.join(first.select("head", F.col("id").alias("neighbour")), "head").select("id", "neighbour", F.lit(1.0).alias("similarity"))
        return spread.unionByName(among)


def linked_pairs(neighbours: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs of which at least one is a neighbour of the other."""
    return neighbours.select(F.least("id", "neighbour").alias("a"), F.greatest("id", "neighbour").alias("b")).distinct()
