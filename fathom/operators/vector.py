"""Exact nearest neighbours by inner product."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.session import materialize

#: Bytes of packed query vectors that may be broadcast.
BROADCAST_BYTES = 64 << 20


def usable(vector: Column, dim: int) -> Column:
    """Not null, of the right dimension, finite throughout and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


def state(vector: Column, dim: int) -> Column:
    """Why a vector takes part in a search or does not."""
    return (
        F.when(vector.isNull(), "null")
        .when(F.size(vector) != dim, "dimension")
        .when(~F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), "not finite")
        .when(F.forall(vector, lambda x: x == 0), "zero")
        .otherwise("usable")
    )


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def top_k(df: DataFrame, query: Sequence[float], k: int, id_col: str, vector_col: str) -> DataFrame:
    """(id, score): one known query is a literal, so that the scan is a plain projection and the sort keeps k rows a task."""
    literal = F.array(*(F.lit(float(x)) for x in query))
    scored = df.where(usable(F.col(vector_col), len(query))).select(id_col, inner_product(F.col(vector_col), literal).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def best_places(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k best finite scores of each row, best first; of equal scores the lesser id is better."""
    least = -np.inf
    if k < score.shape[1]:
        least = np.partition(score, score.shape[1] - k, 1)[:, score.shape[1] - k, None]
    q, d = np.nonzero((score >= least) & np.isfinite(score))
    order = np.lexsort((ids[d], -score[q, d], q))
    q, d = q[order], d[order]
    place = np.arange(len(q)) - np.searchsorted(q, q)
    return q[place < k], d[place < k]


def top_k_batch(queries: DataFrame, corpus: DataFrame, k: int, dim: int, query_id: str = "query_id", id_col: str = "id", vector_col: str = "vector", keep_self: bool = True) -> DataFrame:
    """(query_id, id, score, rank): the k best rows for each query.

    Queries are packed into blocks that meet every batch of the corpus. Up to ``BROADCAST_BYTES`` of them go to all
    tasks, so that the corpus is read once; beyond that, partitions meet pairwise. Each batch sends on its k best rows
    a query only.
    """
    kind = corpus.schema[id_col].dataType.simpleString()
    # of what makes a vector usable the JVM tests the size; the numbers are tested as whole arrays
    right = F.col("v").isNotNull() & (F.size("v") == dim) & F.col("id").isNotNull()
    picked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(vector_col).alias("v")).where(right)
    rows = corpus.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where(right)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                data = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                good = np.isfinite(data).all(1) & (data != 0).any(1)
                ids, data = part.column(0).to_numpy()[good], data[good]
                yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary())], names=["ids", "data"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                qid, qv, ids, data = (batch.column(c)[r].as_buffer() for c in range(4))
                qid, ids = np.frombuffer(qid, np.int64), np.frombuffer(ids, np.int64)
                # equal vectors must tie, whatever order their products were summed in
                score = np.round(np.frombuffer(qv).reshape(-1, dim) @ np.frombuffer(data).reshape(-1, dim).T, 9)
                if not keep_self:
                    score = np.where(qid[:, None] == ids[None, :], -np.inf, score)
                q, d = best_places(score, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[q]), pa.array(ids[d]), pa.array(score[q, d])], names=["query_id", "id", "score"])

    packed = "ids binary, data binary"
    left = materialize(picked.mapInArrow(pack, packed).toDF("qids", "qdata"), "query-blocks")
    right = rows.mapInArrow(pack, packed)
    size = left.agg(F.sum(F.length("qids") + F.length("qdata"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        met = right.crossJoin(F.broadcast(left)).select("qids", "qdata", "ids", "data")
    else:
        met = left.crossJoin(right)
    found = met.mapInArrow(meet, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("id", F.col("id").cast(kind))
