"""Registration of queries, and what several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.functions.text import STOP_WORDS
from fathom.operators import keyword
from fathom.session import shared_path, spread
from fathom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a plan under its own name, with the SQL that it is checked against."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(c, name: str):
    return F.round(c, 6).alias(name)


_indexes: dict[tuple, keyword.KeywordIndex] = {}


def stored_postings(t: Tables) -> keyword.KeywordIndex:
    """The keyword index of a folder's chunks in the shared folder: written by the first query that needs it, and anew when the table's files change."""
    spark = t.spark
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{t.dir}/chunks.parquet")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = fs.listStatus(at)
    key = (spark.sparkContext.applicationId, t.dir, tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files)))
    if key not in _indexes:
        parts = max(1, sum(n for _, n, _ in key[2]) // (16 * (64 << 20)))
        _indexes[key] = keyword.KeywordIndex.write(keyword.postings(t.spread("chunks")), shared_path(spark, "postings", lasting=True), parts=parts)
    return _indexes[key]


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    def spread(self, name: str) -> DataFrame:
        """For plans that do much with each row."""
        return spread(table(self.spark, self.dir, name))


#: Requests with a number that names their vector in the table of embeddings.
REQUESTS = (
    (1, "bucket policy"),
    (2, "versioned container"),
    (3, "the queue of a role"),
    (4, "of the"),
    (5, "die Warteschlangen der Konsole"),
    (6, "snapshot replica lease"),
    (7, "legacy secret"),
    (8, "console lists pending lock"),
)
#: A request whose text could not be embedded.
UNEMBEDDED = (9, "regional zone")


def requests(t: Tables) -> DataFrame:
    """(query_id, query): the fixed requests, and the questions of the evaluation items from 1000 on."""
    fixed = t.spark.createDataFrame([*REQUESTS, UNEMBEDDED], "query_id long, query string")
    return fixed.unionByName(t.eval_item.select((F.col("item_id") + 1000).alias("query_id"), "query"))


def embedded_requests(t: Tables) -> DataFrame:
    """(query_id, query, vector) of the fixed requests."""
    fixed = t.spark.createDataFrame([*REQUESTS, UNEMBEDDED], "query_id long, query string")
    vectors = t.embeddings.where(F.col("vec_id").isin([i for i, _ in REQUESTS])).select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    return fixed.join(vectors, "query_id", "left")


_VALUES = ", ".join(f"(CAST({i} AS BIGINT), '{q}')" for i, q in (*REQUESTS, UNEMBEDDED))
FIXED_SQL = f"fixed AS (SELECT * FROM (VALUES {_VALUES}) v(query_id, query))"
REQUESTS_SQL = FIXED_SQL + ", requests AS (SELECT * FROM fixed UNION ALL SELECT item_id + 1000, query FROM eval_item)"
USABLE_SQL = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
_STOPS = f"(SELECT unnest(string_split('{STOP_WORDS}', ' ')))"
POSTINGS_SQL = rf"""
    path_words AS (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(coalesce(section_path, '')), '[\p{{L}}\p{{N}}]+') AS w FROM chunks)),
    text_words AS (SELECT chunk_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM (SELECT chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]+') AS w FROM chunks)),
    path_kept AS (SELECT * FROM path_words WHERE term NOT IN {_STOPS}),
    shift AS (SELECT chunk_id, max(pos) AS s FROM path_kept GROUP BY 1),
    postings AS (
        SELECT chunk_id, term, CAST(pos AS INTEGER) AS pos, 'A' AS weight FROM path_kept
        UNION ALL
        SELECT t.chunk_id, term, CAST(pos + coalesce(s, 0) AS INTEGER), 'B' FROM text_words t LEFT JOIN shift USING (chunk_id) WHERE term NOT IN {_STOPS}
    )"""
TERMS_SQL = rf"""
    term_sets AS (SELECT query_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]+'), lambda w: NOT list_contains(string_split('{STOP_WORDS}', ' '), w)))) AS terms FROM requests),
    terms AS (SELECT query_id, unnest(terms) AS term, generate_subscripts(terms, 1) - 1 AS term_no, len(terms) AS n_terms FROM term_sets)"""
HITS_SQL = """
    asked AS (SELECT p.chunk_id, p.term, p.pos, p.weight, t.query_id, t.term_no, t.n_terms FROM postings p JOIN terms t ON p.term = t.term),
    whole AS (SELECT query_id, chunk_id FROM asked GROUP BY 1, 2 HAVING count(DISTINCT term_no) = max(n_terms)),
    hits AS (
        SELECT *, CASE weight WHEN 'A' THEN 1.0 ELSE 2.5 END::DOUBLE AS inv, row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY pos) AS idx
        FROM asked JOIN whole USING (query_id, chunk_id)
    )"""
COVER_SQL = """
    summed AS (SELECT *, sum(inv) OVER (PARTITION BY query_id, chunk_id ORDER BY idx) AS total FROM hits),
    latest AS (
        SELECT h.query_id, h.chunk_id, h.idx, h.pos, h.n_terms, h.total, t.term_no AS other,
               max(CASE WHEN h.term_no = t.term_no THEN h.idx END) OVER (PARTITION BY h.query_id, h.chunk_id, t.term_no ORDER BY h.idx) AS here
        FROM summed h JOIN terms t ON h.query_id = t.query_id
    ),
    spans AS (
        SELECT query_id, chunk_id, idx, any_value(pos) AS q, any_value(total) AS total, CASE WHEN count(here) = any_value(n_terms) THEN min(here) END AS first
        FROM latest GROUP BY 1, 2, 3
    ),
    fresh AS (SELECT *, first IS NOT NULL AND first > coalesce(lag(first) OVER (PARTITION BY query_id, chunk_id ORDER BY idx), 0) AS new FROM spans),
    cover AS (
        SELECT f.query_id, f.chunk_id, round(sum((f.idx - f.first + 1) / (f.total - s.total + s.inv) / (1 + (f.q - s.pos) - (f.idx - f.first))), 9) AS score
        FROM fresh f JOIN summed s ON s.query_id = f.query_id AND s.chunk_id = f.chunk_id AND s.idx = f.first
        WHERE f.new GROUP BY 1, 2
    ),
    ranked_kw AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM cover)"""
VECTOR_ARM_SQL = f"""
    corpus AS (SELECT chunk_id, embedding::DOUBLE[] AS v FROM chunks WHERE {USABLE_SQL}),
    asked_vec AS (SELECT f.query_id, e.embedding::DOUBLE[] AS v FROM fixed f JOIN embeddings e ON e.vec_id = f.query_id WHERE f.query_id <> {UNEMBEDDED[0]}),
    scored_vec AS (SELECT query_id, chunk_id, round(list_inner_product(a.v, c.v), 9) AS score FROM asked_vec a CROSS JOIN corpus c),
    ranked_vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored_vec)"""
HYBRID_SQL = f"""WITH {FIXED_SQL}, requests AS (SELECT * FROM fixed), {POSTINGS_SQL}, {TERMS_SQL}, {HITS_SQL}, {COVER_SQL}, {VECTOR_ARM_SQL},
    stacked AS (
        SELECT query_id, chunk_id, rank AS vector_rank, NULL::BIGINT AS keyword_rank FROM ranked_vec WHERE rank <= 30
        UNION ALL SELECT query_id, chunk_id, NULL, rank FROM ranked_kw WHERE rank <= 30 AND query_id <> {UNEMBEDDED[0]}
    ),
    fused AS (
        SELECT query_id, chunk_id, CAST(min(vector_rank) AS INTEGER) AS vector_rank, CAST(min(keyword_rank) AS INTEGER) AS keyword_rank,
               coalesce(1.0::DOUBLE / (60 + min(vector_rank)), 0) + coalesce(1.0::DOUBLE / (60 + min(keyword_rank)), 0) AS score
        FROM stacked GROUP BY 1, 2
    ),
    cut AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM fused),
    plain AS (
        SELECT query_id, chunk_id, NULL::INTEGER AS vector_rank, CAST(rank AS INTEGER) AS keyword_rank, score, CAST(rank AS INTEGER) AS rank FROM ranked_kw
        WHERE query_id = {UNEMBEDDED[0]} AND rank <= 10
    ),
    results AS (
        SELECT *, 'rrf' AS score_kind FROM cut WHERE rank <= 10
        UNION ALL SELECT *, 'keyword' FROM plain
    )"""
