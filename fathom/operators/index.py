"""Change detection, upserts and a versioned store of the index tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fathom.session import exact_unions, materialize


def newest(df: DataFrame, key: str, at: str, *ties: str) -> DataFrame:
    """The newest row of each key, nulls of ``at`` oldest; ties go to the greater values of ``ties``.

    An aggregate of structs, not a window: it combines before the shuffle, so a key with very many rows is no hot spot.
    """
    rest = [c for c in df.columns if c != key]
    first = [at, *ties]
    ordered = F.struct(*first, *[c for c in rest if c not in first]) if all(c in rest for c in first) else None
    if ordered is None:
        raise ValueError(f"{first} are not all columns")
    maps = [c for c in rest if df.schema[c].dataType.typeName() == "map"]
    if maps:  # maps have no order
        w = Window.partitionBy(key).orderBy(*(F.desc_nulls_last(c) for c in first))
        return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return df.groupBy(key).agg(F.max(ordered).alias("_n")).select(key, *(F.col(f"_n.{c}").alias(c) for c in rest)).select(*df.columns)


def changed(pages: DataFrame, state: DataFrame) -> DataFrame:
    """Pages whose content hash is not the one last seen for their url; pages without hash are changed."""
    known = newest(state.where("url IS NOT NULL").select("url", "last_crawled_at", "content_hash"), "url", "last_crawled_at", "content_hash")
    return pages.join(known.select("url", "content_hash").where("content_hash IS NOT NULL"), ["url", "content_hash"], "left_anti")


def merge_state(state: DataFrame, crawled: DataFrame) -> DataFrame:
    """(url, content_hash, last_crawled_at) after a crawl: one row per url, the newest fetch over what was known."""
    exact_unions(state.sparkSession)
    cols = ("url", "content_hash", "last_crawled_at")
    both = state.select(*cols, F.lit(0).alias("_new")).unionByName(crawled.select("url", "content_hash", F.col("crawled_at").alias("last_crawled_at"), F.lit(1).alias("_new")))
    return newest(both.where("url IS NOT NULL").select("url", "_new", "last_crawled_at", "content_hash"), "url", "_new", "last_crawled_at", "content_hash").select(*cols)


def replace_rows(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The old table with all rows of the new one's keys replaced."""
    exact_unions(old.sparkSession)
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def document_id(url_col: str = "url"):
    """The same id for a url on each run."""
    return F.xxhash64(url_col)


def chunk_id(url_col: str = "url", index_col: str = "chunk_index"):
    return F.xxhash64(url_col, index_col)


def numbered(df: DataFrame, order: str, *ties: str, name: str = "position") -> DataFrame:
    """The rows with their place in the order, from 1. Places are counted in range partitions and shifted by the rows
    before each partition, of which there are as many as partitions: no task sees all rows."""
    cols = [order, *ties]
    ranged = materialize(df.repartitionByRange(*cols).sortWithinPartitions(*cols).withColumn("_part", F.spark_partition_id()), "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = ranged.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return ranged.join(F.broadcast(shifts), "_part").withColumn(name, (place + F.col("_shift")).cast("int")).drop("_part", "_shift")


def merge_unique(first: DataFrame, second: DataFrame, key: str = "url") -> DataFrame:
    """Ordered union without repetition: (key, position) by the first place a key stands at; each side has key and position."""
    exact_unions(first.sparkSession)
    both = first.select(key, F.lit(0).alias("side"), "position").unionByName(second.select(key, F.lit(1).alias("side"), "position"))
    least = both.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("side", "position")).alias("p"))
    return numbered(least.select(key, "p.side", F.col("p.position").alias("at")), "side", "at").select(key, "position")


class VersionedStore:
    """Tables of one index as versions under a folder.

    Rows lie in buckets of their key's hash. A commit writes the buckets that change into a folder of its own, then
    names the files of all tables in one numbered manifest, which is renamed into place: a reader sees a whole version
    or the one before. A commit that broke off leaves no manifest, and the next one takes its number. What an update
    costs goes by the buckets that it touches, not by the table. One writer at a time.
    """

    #: The column that rows of a table are replaced by.
    KEYS = {"documents": "url", "chunks": "document_id", "crawl_state": "url"}

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def version(self) -> int:
        return max((int(n[:-5]) for n in self._names(f"{self.root}/_versions") if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self) -> dict:
        version = self.version()
        if not version:
            return {"version": 0, "buckets": self.buckets, "tables": {}}
        stream = self._fs.open(self._path(f"{self.root}/_versions/{version:012d}.json"))
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _bucket(self, key: str | None, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int") if key else F.lit(0)

    def _touched(self, keys: DataFrame, key: str, buckets: int) -> set[int]:
        """Buckets of the keys, at most as many as there are buckets."""
        return {r[0] for r in keys.select(self._bucket(key, buckets).alias("b")).distinct().collect()}

    def _read(self, named: dict, only: set[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(named["schema"])
        paths = sorted({p for b, p in named["parts"].items() if only is None or int(b) in only})
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def read(self, table: str, keys: DataFrame | None = None) -> DataFrame | None:
        """A table, or of it the buckets that hold the keys of a frame."""
        now = self._manifest()
        named = now["tables"].get(table)
        if named is None:
            return None
        return self._read(named, None if keys is None or not named["key"] else self._touched(keys, named["key"], now["buckets"]))

    def _write(self, df: DataFrame, version: int, table: str, key: str | None, buckets: int) -> dict[str, str]:
        """Writes rows by bucket; gives the folder of each bucket that has any."""
        at = f"v{version}/{table}"
        df.withColumn("_bucket", self._bucket(key, buckets)).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.root}/{at}")
        return {n.split("=")[1]: f"{at}/{n}" for n in self._names(f"{self.root}/{at}") if n.startswith("_bucket=")}

    def _publish(self, now: dict) -> int:
        folder, version = f"{self.root}/_versions", now["version"]
        fresh, final = self._path(f"{folder}/.{version:012d}.tmp"), self._path(f"{folder}/{version:012d}.json")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        if self._fs.exists(final) or not self._fs.rename(fresh, final):
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes whole tables; the others stay as they are."""
        now = self._manifest()
        now["version"] += 1
        for name, df in tables.items():
            key = self.KEYS.get(name) if self.KEYS.get(name) in df.columns else None
            now["tables"][name] = {"key": key, "schema": df.schema.jsonValue(), "parts": self._write(df, now["version"], name, key, now["buckets"])}
        return self._publish(now)

    def update(self, changes: dict[str, tuple[DataFrame, DataFrame]]) -> int:
        """For each table (keys, rows): the rows of these keys go, the new rows come. Only buckets of the keys are read and written."""
        now = self._manifest()
        now["version"] += 1
        for name, (keys, rows) in changes.items():
            key, named = self.KEYS[name], now["tables"].get(name)
            if named is None or named["key"] != key:
                old = None if named is None else self._read(named)
                df = rows if old is None else replaced(old, keys, rows, key)
                now["tables"][name] = {"key": key, "schema": df.schema.jsonValue(), "parts": self._write(df, now["version"], name, key, now["buckets"])}
                continue
            touched = self._touched(keys.select(key).unionByName(rows.select(key)), key, now["buckets"])
            df = replaced(self._read(named, touched), keys, rows, key)
            parts = self._write(df, now["version"], name, key, now["buckets"])
            named["parts"] = {b: p for b, p in named["parts"].items() if int(b) not in touched} | parts
            named["schema"] = df.schema.jsonValue()
        return self._publish(now)


def replaced(old: DataFrame, keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The old rows but for those of the keys, and the new rows."""
    exact_unions(old.sparkSession)
    return old.join(keys.select(key).distinct(), key, "left_anti").unionByName(rows, allowMissingColumns=True)


def upsert(store: VersionedStore, documents: DataFrame, chunks: DataFrame, state: DataFrame | None = None) -> int:
    """Replaces documents by url, their chunks by document_id (also where the new one has none) and crawl states by url, in one version."""
    changes = {"documents": (documents, documents), "chunks": (documents.select(F.col("doc_id").alias("document_id")), chunks)}
    if state is not None:
        changes["crawl_state"] = (state, state)
    return store.update(changes)
