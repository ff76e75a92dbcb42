"""Weighted postings, conjunctive match and cover-density rank.

A section path's words weigh A, a text's words B and stand behind them. Stop words are not
indexed but keep their positions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathom.functions import text as T

WEIGHTS = {"A": 1.0, "B": 0.4}


def postings(df: DataFrame, id_col: str = "chunk_id", path_col: str = "section_path", text_col: str = "text", stops: Sequence[str] = tuple(T.STOP_WORDS.split())) -> DataFrame:
    """(id, term, pos, weight): narrow, one row per indexed word. Words are counted from 1; stop words go after the split, as a filter over rows."""
    split = df.select(F.col(id_col), T.words(F.coalesce(F.col(path_col), F.lit(""))).alias("_a"), T.words(F.coalesce(F.col(text_col), F.lit(""))).alias("_b"))
    stop = (lambda w: w.isin(*stops)) if stops else (lambda w: F.lit(False))
    # the text's words stand behind the last path word that is indexed
    shift = F.coalesce(F.array_max(F.transform("_a", lambda w, i: F.when(~stop(w), i + 1))), F.lit(0))
    placed = split.select(id_col, F.size("_a").alias("_n"), shift.alias("_shift"), F.posexplode(F.concat("_a", "_b")).alias("_i", "term")).where(~stop(F.col("term")))
    in_path = F.col("_i") < F.col("_n")
    return placed.select(id_col, "term", F.when(in_path, F.col("_i") + 1).otherwise(F.col("_i") - F.col("_n") + 1 + F.col("_shift")).alias("pos"), F.when(in_path, "A").otherwise("B").alias("weight"))


class KeywordIndex:
    """Postings of one table, written once and read by term.

    Rows lie in folders by bucket of their term and are sorted by term, so a search reads the folders of the terms it
    asks for, and in these the row groups that hold them.
    """

    #: Asked terms up to this number are pushed down to the scan as literals; more are joined by bucket and term.
    LITERAL_TERMS = 1000

    def __init__(self, spark: SparkSession, path: str, buckets: int) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")

    @classmethod
    def write(cls, posted: DataFrame, path: str, buckets: int = 16, parts: int = 1, id_col: str = "chunk_id") -> KeywordIndex:
        """Writes postings. ``parts`` files a bucket: terms of very many records are dealt out by record."""
        made = cls(posted.sparkSession, path, buckets)
        keyed = posted.withColumn("bucket", made._bucket())
        dealt = keyed.repartition(buckets * parts, "bucket", F.pmod(F.xxhash64(id_col), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(path)
        return made

    def all(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def of(self, terms: DataFrame) -> DataFrame:
        """Postings of the terms of a frame (term, ...)."""
        stored, wanted = self.spark.read.parquet(self.path), terms.select("term", self._bucket().alias("bucket")).distinct()
        few = wanted.limit(self.LITERAL_TERMS + 1).collect()
        if len(few) > self.LITERAL_TERMS:
            return stored.join(wanted, ["bucket", "term"], "left_semi").drop("bucket")
        if not few:
            return stored.limit(0).drop("bucket")
        buckets, few = sorted({r.bucket for r in few}), [r.term for r in few]
        return stored.where(F.col("bucket").isin(buckets) & F.col("term").isin(few)).drop("bucket")


def stemmed(posted: DataFrame) -> DataFrame:
    """Postings of word stems. Each distinct term is stemmed once."""
    from fathom.functions.stem import english_stem

    terms = posted.select("term").distinct().withColumn("stem", english_stem("term"))
    return posted.join(terms, "term").drop("term").withColumnRenamed("stem", "term")


def term_stats(posted: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(term, records, occurrences), by way of counts per record and term."""
    return posted.groupBy("term", id_col).agg(F.count("*").alias("n")).groupBy("term").agg(F.count("*").alias("records"), F.sum("n").alias("occurrences"))


def query_terms(requests: DataFrame, query_id: str = "query_id", query_col: str = "query", stops: Sequence[str] = tuple(T.STOP_WORDS.split())) -> DataFrame:
    """(query_id, term, term_no, n_terms): the distinct terms of each query that has any."""
    found = F.array_distinct(T.words(F.col(query_col)))
    if stops:
        found = F.filter(found, lambda w: ~w.isin(*stops))
    terms = requests.select(F.col(query_id).alias("query_id"), F.array_sort(found).alias("terms"))
    return terms.select("query_id", F.posexplode("terms").alias("term_no", "term"), F.size("terms").alias("n_terms"))


def hits(posted: DataFrame, terms: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Postings of query terms, of records that hold all terms of the query. Only postings of asked terms are shuffled."""
    asked = posted.join(terms, "term")
    whole = F.size(F.collect_set("term_no").over(Window.partitionBy("query_id", id_col))) == F.col("n_terms")
    return asked.withColumn("_all", whole).where("_all").drop("_all")


def matches(hit: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    return hit.select("query_id", id_col).distinct()


def cover_density(hit: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score): each smallest span that covers all terms adds the harmonic mean of the weights of the
    hits in it, less for every word between them.

    One fold over a record's hits, which are as many as the query's words in one record.
    """
    inverse = F.when(F.col("weight") == "A", 1 / WEIGHTS["A"]).otherwise(1 / WEIGHTS["B"])
    # running sums of 1 / weight, so that a span's sum is a difference
    before = Window.partitionBy("query_id", id_col).orderBy("pos", "term_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = hit.select("query_id", id_col, "n_terms", "pos", "term_no", inverse.alias("inv")).withColumn("total", F.sum("inv").over(before))
    grouped = rows.groupBy("query_id", id_col, "n_terms").agg(F.array_sort(F.collect_list(F.struct("pos", "term_no", "inv", "total"))).alias("h"))
    start = F.struct(F.array_repeat(F.lit(-1), F.col("n_terms")).alias("last"), F.lit(-1).alias("seen"), F.lit(0).alias("i"), F.lit(0.0).alias("score"))

    def step(acc: Column, x: Column) -> Column:
        last = F.transform(acc.last, lambda v, t: F.when(t == x.term_no, acc.i).otherwise(v))
        first = F.array_min(last)
        begin = F.get("h", first)
        n = acc.i - first + 1
        gap = x.pos - begin["pos"]
        new = (first >= 0) & (first > acc.seen)
        return F.struct(last.alias("last"), F.when(new, first).otherwise(acc.seen).alias("seen"), (acc.i + 1).alias("i"), (acc.score + F.when(new, n / (x.total - begin["total"] + begin["inv"]) / (1 + gap - (n - 1))).otherwise(0.0)).alias("score"))

    return grouped.select("query_id", id_col, F.round(F.aggregate("h", start, step, lambda acc: acc.score), 9).alias("score"))


def top_k(scored: DataFrame, k: int, id_col: str = "chunk_id") -> DataFrame:
    """(query_id, id, score, rank): ties go to the lesser id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
