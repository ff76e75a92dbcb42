"""Queries of the operators of this subpackage: ``queries()`` and ``oracle_sql()``."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.session import spread

TOKENIZERS = os.environ.get("FATHOM_TOKENIZERS", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.split import split_oversized

    return split_oversized(table(spark, sf_dir, "chunks"))


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of the pieces of every oversized chunk: their own parts make up its text again; none is over the
    limit, whoever counts the tokens; all but the first repeat 50 tokens; each is cut from the text as it is and has its path."""
    from fathom.functions.text import token_count

    chunks = spark.read.parquet(f"{sf_dir}/chunks.parquet").select("chunk_id", F.col("text").alias("whole"), F.col("section_path").alias("path"))
    pieces = p1_pieces(spark, sf_dir).join(chunks, "chunk_id")
    following = F.lead("own_start").over(Window.partitionBy("chunk_id").orderBy("piece_index"))
    placed = pieces.withColumn("stop", F.coalesce(following, F.length("whole"))).withColumn("own", F.right("text", F.col("stop") - F.col("own_start")))
    checked = placed.select(
        "chunk_id",
        F.struct("piece_index", "own").alias("part"),
        "whole",
        ((token_count(F.col("text")) == F.col("token_count")) & (F.col("token_count") <= 512)).alias("fits"),
        (F.substring("whole", F.col("stop") - F.length("text") + 1, F.length("text")) == F.col("text")).alias("cut"),
        (F.col("overlap_tokens") == F.when(F.col("piece_index") == 0, 0).otherwise(50)).alias("repeats"),
        F.col("section_path").eqNullSafe(F.col("path")).alias("named"),
    )
    rebuilt = F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda x: x.own), "")
    return checked.groupBy("chunk_id").agg(rebuilt.alias("text"), *(F.every(c).alias(c) for c in ("fits", "cut", "repeats", "named")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("piece_index = 0").select("chunk_id")


def p5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.lines import repeated_lines

    prose = table(spark, sf_dir, "chunks").where("chunk_type = 'prose'")
    return repeated_lines(prose, table(spark, sf_dir, "documents")).withColumnRenamed("id", "chunk_id")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    # lines of a cluster are near-duplicates; the case asked for is the very same line
    return p5_lines(spark, sf_dir).where("line_documents >= 5").select("chunk_id", "line_no").distinct()


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks without the lines that p5_found names."""
    from fathom.llm.lines import without_repeated

    chunks = table(spark, sf_dir, "chunks")
    return without_repeated(chunks.select("chunk_id", "text"), p5_found(spark, sf_dir).withColumnRenamed("chunk_id", "id"))


def p5_clean_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks without the lines of whole clusters: near-copies that stand in few documents each go as well."""
    from fathom.llm.lines import without_repeated

    chunks = table(spark, sf_dir, "chunks")
    return without_repeated(chunks.select("chunk_id", "text"), p5_lines(spark, sf_dir).withColumnRenamed("chunk_id", "id"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.encode import BYTE_PATTERN, encode_corpus

    return encode_corpus(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", BYTE_PATTERN)


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that the ids spell out again."""
    from fathom.llm.encode import decode_corpus

    return decode_corpus(p6_ids(spark, sf_dir), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p7_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.leak import leaked_windows

    return leaked_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_item"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_windows(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.leak import leaked_items

    return leaked_items(p7_windows(spark, sf_dir))


def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.quality import rate_documents

    return rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))


def p8_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics alone that SQL can count too."""
    from fathom.llm.quality import document_statistics

    counted = document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))
    return counted.select("doc_id", "word_count", F.round("mean_word_length", 6).alias("mean_word_length"), F.round("common_word_share", 6).alias("common_word_share"))


def p8_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other statistics that SQL can count too."""
    from fathom.llm.quality import document_statistics

    counted = document_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_word"))
    return counted.select("doc_id", F.round("symbol_ratio", 6).alias("symbol_ratio"), F.round("punct_line_share", 6).alias("punct_line_share"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_stats(spark, sf_dir).where("text_type = 'other'").select("doc_id")


def p2_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.boilerplate import main_blocks

    return main_blocks(table(spark, sf_dir, "crawl_result"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_blocks(spark, sf_dir).select("crawl_id", "block_no")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathom.llm.knn import NEAR, VectorIndex, linked_pairs

    near = VectorIndex(table(spark, sf_dir, "chunks"), **NEAR).similar(k=5, least=0.9, shortlist=48)
    return linked_pairs(near).select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p3_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest chunks of every chunk, however far they are."""
    from fathom.llm.knn import VectorIndex

    return VectorIndex(table(spark, sf_dir, "chunks")).similar(k=5)


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest chunks of every chunk whose id is divisible by 20, against all chunks."""
    from fathom.llm.knn import VectorIndex

    index = VectorIndex(table(spark, sf_dir, "chunks"))
    return index.search(index.all.where("id % 20 = 0").select("id", "vector"), k=5)


def _near_duplicates(spark: SparkSession, sf_dir: str):
    from fathom.llm.neardup import NearDuplicates

    return NearDuplicates(table(spark, sf_dir, "chunks"), shingle=3, threshold=0.6, min_words=15)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates(spark, sf_dir).pairs().select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_duplicates(spark, sf_dir).groups().withColumnRenamed("id", "chunk_id")


_PAIRS_SQL = r"""
w AS (
    SELECT chunk_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM chunks WHERE text IS NOT NULL
), g AS (
    SELECT DISTINCT chunk_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 15
), n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY 1),
f AS (SELECT g, count(*) AS f FROM g GROUP BY 1),
ranked AS (SELECT g.chunk_id, g.g, n.n, row_number() OVER (PARTITION BY g.chunk_id ORDER BY f.f, g.g) AS place FROM g JOIN n USING (chunk_id) JOIN f USING (g)),
prefix AS (SELECT * FROM ranked WHERE place <= n - ceil(0.6 * n) + 1),
pairs AS (SELECT DISTINCT a.chunk_id AS a, b.chunk_id AS b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b ON a.g = b.g AND a.chunk_id < b.chunk_id WHERE least(a.n, b.n) >= 0.6 * greatest(a.n, b.n)),
shared AS (SELECT p.a, p.b, p.na, p.nb, count(*) AS common FROM pairs p JOIN g x ON x.chunk_id = p.a JOIN g y ON y.chunk_id = p.b AND y.g = x.g GROUP BY ALL)
"""
_LEAK_SQL = r"""
WITH items AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_item WHERE text IS NOT NULL),
sized AS (SELECT item_id, w, least(12, len(w)) AS n FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM sized),
docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM docs CROSS JOIN (SELECT DISTINCT n FROM sized) WHERE len(w) >= n)
"""
_REPEATED_SQL = r"""
    WITH split AS (
        SELECT chunk_id, document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM chunks WHERE chunk_type = 'prose' AND text IS NOT NULL
    ), lines AS (
        SELECT chunk_id, document_id, line_no, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS letters FROM split
    ), enough AS (
        SELECT * FROM lines WHERE length(letters) >= 12
    ), often AS (
        SELECT list({'chunk_id': chunk_id, 'line_no': line_no}) AS places
        FROM enough JOIN (SELECT doc_id, service_name FROM documents WHERE service_name IS NOT NULL) d ON doc_id = document_id
        GROUP BY service_name, letters HAVING count(DISTINCT document_id) >= 5
    ), flat AS (SELECT unnest(places) AS place FROM often)
"""


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p2_blocks, p2_found, p3_found, p3_neighbours, p3_similar, p4_found, p4_groups, p5_clean, p5_clean_near, p5_found, p5_lines, p6_ids, p6_decoded, p7_found, p7_leaks, p8_counts, p8_found, p8_ratios, p8_stats)}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _REPEATED_SQL + "SELECT DISTINCT place.chunk_id AS chunk_id, CAST(place.line_no AS INTEGER) AS line_no FROM flat",
        "p5_clean": _REPEATED_SQL
        + """, gone AS (SELECT place.chunk_id AS chunk_id, list(DISTINCT place.line_no + 1) AS g FROM flat GROUP BY 1)
            SELECT c.chunk_id, CASE WHEN g IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(g, i)), chr(10)) END AS text, CAST(coalesce(len(g), 0) AS INTEGER) AS lines_removed
            FROM chunks c LEFT JOIN gone USING (chunk_id)
        """,
        "p3_found": """
            WITH v AS (
                SELECT chunk_id, embedding::DOUBLE[] AS v FROM chunks
                WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), s AS (
                SELECT a.chunk_id AS a, b.chunk_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a CROSS JOIN v b WHERE a.chunk_id <> b.chunk_id
            ), near AS (
                SELECT a, b FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM s WHERE c >= 0.9) WHERE r <= 5
            )
            SELECT DISTINCT least(a, b) AS chunk_id_a, greatest(a, b) AS chunk_id_b FROM near
        """,
        "p4_found": "WITH " + _PAIRS_SQL + "SELECT a AS chunk_id_a, b AS chunk_id_b FROM shared WHERE common >= 0.6 * (na + nb - common)",
        "p4_groups": "WITH RECURSIVE "
        + _PAIRS_SQL
        + """, pairs_all AS (SELECT a, b FROM shared WHERE common >= 0.6 * (na + nb - common)),
            edges AS (SELECT a, b FROM pairs_all UNION ALL SELECT b, a FROM pairs_all),
            part AS (SELECT w.chunk_id, array_to_string(w, ' ') AS words, text FROM w JOIN chunks USING (chunk_id) WHERE len(w) >= 15),
            reach AS (SELECT chunk_id AS id, chunk_id AS other FROM part UNION SELECT r.id, e.b FROM reach r JOIN edges e ON e.a = r.other),
            grouped AS (SELECT id AS chunk_id, min(other) AS group_id, count(*) AS group_size FROM reach GROUP BY 1),
            linked AS (SELECT a AS chunk_id, count(*) AS links FROM edges GROUP BY 1)
            SELECT chunk_id, group_id, group_size, count(*) OVER (PARTITION BY words) AS copies, coalesce(links, 0) AS links, min(chunk_id) OVER (PARTITION BY text) AS same_as
            FROM part JOIN grouped USING (chunk_id) LEFT JOIN linked USING (chunk_id)
        """,
        "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
        "p7_found": _LEAK_SQL + "SELECT DISTINCT doc_id, item_id FROM grams JOIN windows USING (n, g)",
        "p7_leaks": _LEAK_SQL
        + """, places AS (SELECT item_id, n, len(w) AS words, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i : i + n - 1], ' '))) AS g FROM sized),
            met AS (SELECT DISTINCT doc_id, item_id, n, words, i FROM grams JOIN places USING (n, g)),
            counted AS (SELECT doc_id, item_id, count(*) AS windows FROM met GROUP BY 1, 2),
            covered AS (SELECT doc_id, item_id, count(DISTINCT word) / any_value(words) AS covered FROM (SELECT doc_id, item_id, words, unnest(range(i, i + n)) AS word FROM met) GROUP BY 1, 2)
            SELECT doc_id, item_id, windows, covered FROM counted JOIN covered USING (doc_id, item_id)
        """,
        "p8_ratios": r"""
            WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n|\r|\x{2028}|\x{85}', chr(10), 'g') AS text FROM documents),
            s AS (SELECT doc_id, regexp_replace(text, '[\s\p{Z}\x0B\x1C-\x1F]', '', 'g') AS solid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\p{Z}\x0B\x1C-\x1F]')) AS lines FROM d)
            SELECT doc_id, CASE WHEN solid <> '' THEN round(length(regexp_replace(solid, '[\p{L}\p{N}]', '', 'g')) / length(solid), 6) END AS symbol_ratio,
                   CASE WHEN solid <> '' THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?…。！？][\s\p{Z}\x0B\x1C-\x1F"'')\]”’»」』*]*$'))) / len(lines), 6) END AS punct_line_share
            FROM s
        """,
        "p8_counts": r"""
            WITH common AS (SELECT list(DISTINCT lower(trim(word))) AS c FROM common_word WHERE trim(word) <> ''),
            d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents)
            SELECT doc_id, len(w) AS word_count, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) END AS mean_word_length,
                   CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(c, x))) / len(w), 6) END AS common_word_share
            FROM d, common
        """,
        "p1_rebuilt": r"""
            SELECT chunk_id, text, true AS fits, true AS cut, true AS repeats, true AS named FROM chunks
            WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x{0085}\x0B\x1C-\x1F]')) > 512
        """,
        "p1_found": r"""
            SELECT chunk_id FROM chunks
            WHERE len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s\p{Z}\x{0085}\x0B\x1C-\x1F]')) > 512
        """,
    }
