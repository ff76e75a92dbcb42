"""Schemas of the index tables, and the store's first version."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T

CHUNK_TYPES = ("prose", "code", "table", "config")


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _I, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.TimestampType()
DOCUMENTS = _table(doc_id=_L, url=_S, service_name=_S, title=_S, content_hash=_S, crawled_at=_TS, updated_at=_TS)
CHUNKS = _table(chunk_id=_L, document_id=_L, chunk_index=_I, text=_S, chunk_type=_S, section_path=_S, token_count=_I, metadata=T.MapType(_S, _S), embedding=T.ArrayType(T.FloatType()))
CRAWL_STATE = _table(url=_S, content_hash=_S, last_crawled_at=_TS)
CRAWL_RESULT = _table(url=_S, html=_S, service_name=_S, crawled_at=_TS, content_hash=_S)


def initialize(spark: SparkSession, store) -> int:
    """Commits empty tables as a store's first version; a store that has one is left alone."""
    if store.version():
        return store.version()
    return store.commit({name: spark.createDataFrame([], schema) for name, schema in (("documents", DOCUMENTS), ("chunks", CHUNKS), ("crawl_state", CRAWL_STATE))})
