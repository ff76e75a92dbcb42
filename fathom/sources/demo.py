"""A handful of documents to try an index with."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.operators import index
from fathom.operators.embed import HashingEmbedder, embed

#: (url, service, title, chunks as (type, section path, text)).
DOCUMENTS = (
    ("https://demo.docs.example/s3/lifecycle", "s3", "Object lifecycle", (("prose", "Object lifecycle > Rules", "[Object lifecycle > Rules] A lifecycle rule moves objects of a bucket to colder storage after a number of days, or deletes them."), ("code", "Object lifecycle > Rules", "[Object lifecycle > Rules] ```json\n{\"days\": 30, \"to\": \"cold\"}\n```"))),
    ("https://demo.docs.example/sqs/visibility", "sqs", "Visibility of messages", (("prose", "Visibility of messages > Timeout", "[Visibility of messages > Timeout] A message that one worker has received stays hidden from the others until its visibility timeout ends."),)),
    ("https://demo.docs.example/iam/roles", "iam", "Roles", (("prose", "Roles > Trust", "[Roles > Trust] A role's trust policy names who may take on the role."), ("config", "Roles > Trust", "[Roles > Trust] ```json\n{\"Effect\": \"Allow\"}\n```"))),
    ("https://demo.docs.example/lambda/limits", "lambda", "Limits of functions", (("table", "Limits of functions", "[Limits of functions] | limit | value |\n| --- | --- |\n| time | 15 minutes |"),)),
    ("https://demo.docs.example/vpc/subnets", "vpc", "Subnets", (("prose", "Subnets > Sizes", "[Subnets > Sizes] The size of a subnet is fixed when it is made."), ("prose", "Subnets > Routes", "[Subnets > Routes] Each subnet follows one route table."))),
)


def demo_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) as an ingest would hand them on, without vectors. A document's hash is that of its chunks' texts."""
    from fathom.functions.text import token_count

    docs = [(u, s, t, hashlib.sha256("".join(x for _, _, x in c).encode()).hexdigest()) for u, s, t, c in DOCUMENTS]
    pieces = [(u, i, text, kind, path) for u, _, _, c in DOCUMENTS for i, (kind, path, text) in enumerate(c)]
    now = F.current_timestamp()
    documents = spark.createDataFrame(docs, "url string, service_name string, title string, content_hash string").select(index.document_id("url").alias("doc_id"), "*", now.alias("crawled_at"), now.alias("updated_at"))
    chunks = spark.createDataFrame(pieces, "url string, chunk_index int, text string, chunk_type string, section_path string")
    return documents, chunks.select(index.chunk_id().alias("chunk_id"), index.document_id("url").alias("document_id"), "chunk_index", "text", "chunk_type", "section_path", token_count(F.col("text")).alias("token_count"), F.create_map().cast("map<string,string>").alias("metadata"))


def seed_demo(store: index.VersionedStore, factory=HashingEmbedder) -> int:
    """Puts the documents into a store, embedded; doing so again changes nothing but the version."""
    documents, chunks = demo_tables(store.spark)
    return index.upsert(store, documents, embed(chunks, factory=factory))
