"""Readers: parquet tables, url lists, seeds; and settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where the crawl of each service begins.
SEED_URLS = {
    "s3": "https://docs.aws.amazon.com/AmazonS3/latest/userguide/",
    "ec2": "https://docs.aws.amazon.com/AWSEC2/latest/UserGuide/",
    "lambda": "https://docs.aws.amazon.com/lambda/latest/dg/",
    "dynamodb": "https://docs.aws.amazon.com/amazondynamodb/latest/developerguide/",
    "rds": "https://docs.aws.amazon.com/AmazonRDS/latest/UserGuide/",
    "vpc": "https://docs.aws.amazon.com/vpc/latest/userguide/",
    "eks": "https://docs.aws.amazon.com/eks/latest/userguide/",
    "ecs": "https://docs.aws.amazon.com/AmazonECS/latest/developerguide/",
    "iam": "https://docs.aws.amazon.com/IAM/latest/UserGuide/",
    "sqs": "https://docs.aws.amazon.com/AWSSimpleQueueService/latest/SQSDeveloperGuide/",
    "sns": "https://docs.aws.amazon.com/sns/latest/dg/",
    "cloudwatch": "https://docs.aws.amazon.com/AmazonCloudWatch/latest/monitoring/",
    "cloudformation": "https://docs.aws.amazon.com/AWSCloudFormation/latest/UserGuide/",
    "route53": "https://docs.aws.amazon.com/Route53/latest/DeveloperGuide/",
    "elasticache": "https://docs.aws.amazon.com/AmazonElastiCache/latest/dg/",
    "kinesis": "https://docs.aws.amazon.com/streams/latest/dev/",
    "redshift": "https://docs.aws.amazon.com/redshift/latest/dg/",
    "emr": "https://docs.aws.amazon.com/emr/latest/ManagementGuide/",
    "glue": "https://docs.aws.amazon.com/glue/latest/dg/",
    "stepfunctions": "https://docs.aws.amazon.com/step-functions/latest/dg/",
}
#: The services that are crawled when none are named: the first 15.
DEFAULT_SEEDS = tuple(SEED_URLS)[:15]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file: trimmed lines, without blank ones and # comments."""
    return spark.read.text(path).select(F.trim("value").alias("url")).where((F.col("url") != "") & ~F.col("url").startswith("#"))


def seeds(spark: SparkSession, services: list[str] | None = None) -> DataFrame:
    """(service, url, position): names in any case; unknown ones are left out; none named means the default ones."""
    wanted = [s.lower() for s in services] if services else list(DEFAULT_SEEDS)
    rows = [(s, SEED_URLS[s], i) for i, s in enumerate(wanted) if s in SEED_URLS]
    return spark.createDataFrame(rows, "service string, url string, position int")


def first_pages(pages: DataFrame, limit: int, order: str) -> DataFrame:
    return pages.orderBy(order).limit(limit)


@dataclass(frozen=True)
class Settings:
    """Settings of a run, read from ``spark.fathom.*`` where the session has them."""

    chunk_tokens: int = 512
    overlap_tokens: int = 50
    embed_batch: int = 32
    pipeline_batch: int = 128
    crawl_rate: float = 1.0
    crawl_burst: int = 3
    api_rate: float = 10.0
    api_burst: int = 20
    cache_entries: int = 1000
    cache_ttl_seconds: int = 900
    vector_dim: int = 64

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        named = {f.name: spark.conf.get(f"spark.fathom.{f.name}", None) for f in fields(cls)}
        return cls(**{k: type(getattr(cls, k))(float(v)) for k, v in named.items() if v is not None})


def html_responses(fetched: DataFrame) -> DataFrame:
    """Of fetched responses (status, content_type, ...) those that are pages."""
    return fetched.where((F.col("status") == 200) & F.contains(F.lower(F.coalesce("content_type", F.lit(""))), F.lit("text/html")))
