"""URL expressions: normal form, crawl scope, what to skip, service names, links of a page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Urls that are not followed.
SKIP_PATTERNS = (r"/pricing/", r"/api[_-]?ref", r"/APIReference/", r"/release-?notes/", r"\.pdf$", r"\.zip$", r"#")
#: Fixed value: where a documentation url names its service.
SERVICE_PATTERN = r"(?i)docs\.aws\.amazon\.com/(?:Amazon)?(\w+)/"
#: The first label of a host such as objectvault.docs.example.
HOST_SERVICE_PATTERN = r"(?i)^https?://([\w-]+)\.docs\."
#: Services whose url names them otherwise. The last five agree with the ids that service filters use.
SERVICE_ALIASES = {
    "amazons3": "s3",
    "amazonec2": "ec2",
    "awslambda": "lambda",
    "amazondynamodb": "dynamodb",
    "amazonrds": "rds",
    "amazonvpc": "vpc",
    "amazoneks": "eks",
    "amazonecs": "ecs",
    "amazoniam": "iam",
    "amazonsqs": "sqs",
    "amazonsns": "sns",
    "amazoncloudwatch": "cloudwatch",
    "awsec2": "ec2",
    "awssimplequeueservice": "sqs",
    "awscloudformation": "cloudformation",
    "streams": "kinesis",
    "step-functions": "stepfunctions",
}

HREF = r"""(?i)<a\s(?:[^>]*?\s)?href\s*=\s*"([^"]*)\""""


def normalize(url: Column) -> Column:
    """Without fragment, and without trailing slashes unless that would touch the host."""
    bare = F.regexp_replace(url, "(?s)#.*$", "")
    slashes = F.length(bare) - F.length(F.replace(bare, F.lit("/"), F.lit("")))
    return F.when(bare.endswith("/") & (slashes > 3), F.regexp_replace(bare, "/+$", "")).otherwise(bare)


def scope_prefix(seed: Column) -> Column:
    """The directory of a seed: a last path segment with a dot is cut off, the query dropped."""
    base = F.regexp_extract(seed, r"^([^?#]*)", 1)
    root = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/]*)", 1)
    path = F.substring(base, F.length(root) + 1, F.length(base))
    return normalize(F.concat(root, F.when(path.rlike(r"[^/]*\.[^/]*$"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)))


def skipped(url: Column) -> Column:
    return url.rlike("(?i)" + "|".join(SKIP_PATTERNS))


def service_of(url: Column, pattern: str = SERVICE_PATTERN, aliases: dict[str, str] | None = None) -> Column:
    """The service that a url names, by its usual id; ``unknown`` if it names none."""
    name = F.lower(F.regexp_extract(url, pattern, 1))
    pairs = [F.lit(x) for pair in (SERVICE_ALIASES if aliases is None else aliases).items() for x in pair]
    known = F.try_element_at(F.create_map(*pairs), name) if pairs else F.lit(None)
    return F.when(name == "", "unknown").otherwise(F.coalesce(known, name)) if pairs else F.when(name == "", "unknown").otherwise(name)


def hrefs(html: Column) -> Column:
    """The values of href of all anchors, in order, repeated ones too."""
    return F.regexp_extract_all(html, F.lit(HREF), F.lit(1))


def followable(href: Column) -> Column:
    return href.isNotNull() & ~href.startswith("#") & ~href.startswith("javascript:")


@F.pandas_udf(T.StringType())
def resolve(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """href as seen from a page, by the rules of RFC 3986; null where either is null or cannot be read."""
    from urllib.parse import urljoin

    def one(base: str | None, href: str | None) -> str | None:
        try:
            return None if base is None or href is None else urljoin(base, href)
        except ValueError:
            return None

    for bases, links in parts:
        yield pd.Series([one(b, h) for b, h in zip(bases, links)])
