"""Reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.session import exact_unions

K = 60


def rrf(vector: DataFrame, keyword: DataFrame, top_k: int, id_col: str = "chunk_id", k: int = K) -> DataFrame:
    """(query_id, id, score, vector_rank, keyword_rank, rank) of two ranked lists (query_id, id, rank). top_k 0 keeps all.

    One shuffle: the lists are stacked and summed, not joined.
    """
    exact_unions(vector.sparkSession)
    arms = vector.select("query_id", id_col, F.col("rank").alias("vector_rank"), F.lit(None).cast("int").alias("keyword_rank")).unionByName(keyword.select("query_id", id_col, F.lit(None).cast("int").alias("vector_rank"), F.col("rank").alias("keyword_rank")))
    one = arms.groupBy("query_id", id_col).agg(F.min("vector_rank").alias("vector_rank"), F.min("keyword_rank").alias("keyword_rank"))
    part = lambda c: F.when(F.col(c).isNull(), 0.0).otherwise(1.0 / (k + F.col(c)))
    scored = one.withColumn("score", part("vector_rank") + part("keyword_rank"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)))
    return ranked.where(F.col("rank") <= top_k) if top_k > 0 else ranked
