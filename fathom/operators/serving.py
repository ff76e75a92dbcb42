"""Serving state: result caches, rate limits, recent queries; as replays over request logs and as live objects."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fathom.sources.tables import Settings

CACHE_ENTRIES, CACHE_TTL = 1000, 15 * 60
RATE, BURST, IDLE = 10.0, 20, 600
#: Seconds that no log spans.
FOREVER = 1e10


def request_key(query: str, top_k: int, services: Sequence[str] = ()) -> str:
    return hashlib.sha256(f"{query.lower()}|{top_k}|{','.join(sorted(services))}".encode()).hexdigest()


class TtlCache:
    """Least recently used entries of limited age. ``clock`` gives seconds."""

    def __init__(self, entries: int = CACHE_ENTRIES, ttl: float = CACHE_TTL, clock=time.monotonic) -> None:
        self.entries, self.ttl, self.clock = entries, ttl, clock
        self._held: OrderedDict[str, tuple[float, object]] = OrderedDict()

    def get(self, key: str):
        at, value = self._held.get(key, (None, None))
        if at is None:
            return None
        if self.clock() - at >= self.ttl:
            del self._held[key]
            return None
        self._held.move_to_end(key)
        return value

    def put(self, key: str, value: object) -> None:
        self._held[key] = (self.clock(), value)
        self._held.move_to_end(key)
        while len(self._held) > self.entries:
            self._held.popitem(last=False)


class SearchCache:
    """Answers and retrievals under the same keys, in spaces of their own. Empty retrievals and failed answers are not kept."""

    def __init__(self, entries: int = CACHE_ENTRIES, ttl: float = CACHE_TTL, clock=time.monotonic) -> None:
        self.retrievals, self.answers = TtlCache(entries, ttl, clock), TtlCache(entries, ttl, clock)

    def put_retrieval(self, key: str, chunks: Sequence) -> None:
        if chunks:
            self.retrievals.put(key, list(chunks))

    def put_answer(self, key: str, text: str, error: Exception | None = None) -> None:
        if error is None:
            self.answers.put(key, text)


def folded(log: DataFrame, key: str, at: str, ties: Sequence[str], out: T.StructField, make: Callable[[], Callable[[np.ndarray, pa.RecordBatch], np.ndarray]], rest: float) -> DataFrame:
    """The rows of a log with a column that a fold over each key's rows in the order of their times gives.

    ``make`` starts a fold; it is handed times in seconds, and rows, as they come. ``rest`` is the time (seconds) after
    which a key without requests is as new. Where a key rests so long its log is cut, and the parts go to different
    tasks: the cuts come from the spans of that length in which a key has rows. Rows without time are left out. Tasks see sorted rows one batch after the other,
    so a key that never rests costs time, not memory.
    """
    span = max(1, int(np.ceil(rest * 1e6)))
    # an empty span between two that hold rows means a rest
    cell = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / span)
    cells = log.groupBy(key, cell.alias("_cell")).agg(F.lit(1).alias("_one"))
    in_order = Window.partitionBy(key).orderBy("_cell")
    runs = cells.withColumn("_gap", (F.col("_cell") - F.lag("_cell").over(in_order) > 1).cast("int"))
    runs = runs.withColumn("_run", F.sum(F.coalesce("_gap", F.lit(0))).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).select(F.col(key).alias("_key"), F.col("_cell").alias("_begun"), "_run")
    rows = log.withColumn("_cell", cell)
    rows = rows.join(runs, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_cell") == F.col("_begun"))).drop("_key", "_cell", "_begun")
    rows = rows.repartition(key, "_run").sortWithinPartitions(key, "_run", at, *ties)
    names, width = log.columns, len(log.columns)
    schema = T.StructType([*log.schema.fields, out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, fold = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own, runs_of = batch.column(names.index(key)), batch.column(width)
            same = pc.and_(pc.coalesce(pc.equal(own.slice(1), own.slice(0, len(own) - 1)), pc.and_(pc.is_null(own.slice(1)), pc.is_null(own.slice(0, len(own) - 1)))), pc.equal(runs_of.slice(1), runs_of.slice(0, len(own) - 1)))
            starts = np.concatenate([[0], np.flatnonzero(~same.to_numpy(zero_copy_only=False)) + 1, [len(own)]]).astype(np.int64)
            times = batch.column(names.index(at)).to_numpy(zero_copy_only=False).astype("datetime64[us]").astype(np.int64) / 1e6
            values = []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                here = (own[lo].as_py(), runs_of[lo].as_py())
                if fold is None or here != now:
                    now, fold = here, make()
                values.append(fold(times[lo:hi], batch.slice(lo, hi - lo)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(np.concatenate(values))], names=[*names, out.name])

    return rows.select(*names, "_run").mapInArrow(run, schema)


def replay_cache(log: DataFrame, key: str = "key", at: str = "ts", ttl: float | None = None, order: str | None = None) -> DataFrame:
    """The log (key, ts, ...) with ``hit``: whether an entry of the key, filled less than the ttl ago, was there.

    A miss fills, a hit does not refresh, so what a request finds depends on the fill before it. Requests of the same
    time follow each other by ``order``; without it any of them may be the one that fills.
    """
    ttl = Settings.of(log.sparkSession).cache_ttl_seconds if ttl is None else ttl

    def make():
        filled = [-np.inf]

        def fold(times: np.ndarray, _) -> np.ndarray:
            hit = np.zeros(len(times), bool)
            i = int(np.searchsorted(times, filled[0] + ttl))
            hit[:i] = True
            while i < len(times):
                filled[0] = times[i]
                end = int(np.searchsorted(times, times[i] + ttl))
                hit[i + 1 : end] = True
                i = max(end, i + 1)
            return hit

        return fold

    return folded(log, key, at, (order,) if order else (), T.StructField("hit", T.BooleanType()), make, ttl)


def replay_lru(log: DataFrame, cache: str, key: str, at: str, order: str, entries: int | None = None, ttl: float | None = None) -> DataFrame:
    """The log (cache, key, ts, order, ...) with ``hit``: what each cache of bounded size and age, one for each server, would have held.

    A cache's entries push each other out, so its log is one sequence; what a task holds are the entries of one cache.
    """
    settings = Settings.of(log.sparkSession)
    entries, ttl = settings.cache_entries if entries is None else entries, settings.cache_ttl_seconds if ttl is None else ttl
    place = log.columns.index(key)

    def make():
        now = [0.0]
        held = TtlCache(entries, ttl, lambda: now[0])

        def fold(times: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
            hit = np.zeros(len(times), bool)
            for i, k in enumerate(rows.column(place).to_pylist()):
                now[0] = times[i]
                hit[i] = held.get(k) is not None
                if not hit[i]:
                    held.put(k, True)
            return hit

        return fold

    return folded(log, cache, at, (order,), T.StructField("hit", T.BooleanType()), make, ttl)


def token_bucket(times: np.ndarray, rate: float, burst: int, tokens: float, last: float) -> tuple[np.ndarray, float, float]:
    """Which of the times (seconds, ascending) a bucket lets pass, and its tokens and time after them."""
    allowed = np.zeros(len(times), bool)
    for i, t in enumerate(times.tolist()):
        tokens, last = min(burst, tokens + max(0.0, t - last) * rate), max(last, t)
        if tokens >= 1:
            tokens -= 1
            allowed[i] = True
    return allowed, tokens, last


def rate_limit(log: DataFrame, key: str, at: str, order: str, rate: float | None = None, burst: int | None = None) -> DataFrame:
    """(key, order, ts, allowed): a token bucket per key, full at the key's first request."""
    settings = Settings.of(log.sparkSession)
    rate, burst = settings.api_rate if rate is None else rate, settings.api_burst if burst is None else burst

    def make():
        state = [float(burst), -np.inf]

        def fold(times: np.ndarray, _) -> np.ndarray:
            allowed, *state[:] = token_bucket(times, rate, burst, state[0], max(state[1], times[0]) if state[1] == -np.inf else state[1])
            return allowed

        return fold

    return folded(log.select(key, order, at), key, at, (order,), T.StructField("allowed", T.BooleanType()), make, burst / rate)


def admission(log: DataFrame, key: str, at: str, order: str, rate: float | None = None, burst: int | None = None) -> DataFrame:
    """(key, order, ts, wait): seconds that each request waits in a bucket that delays instead of refusing.

    Waits pile up without bound, so no pause between requests is sure to be a rest, and no log is cut.
    """
    settings = Settings.of(log.sparkSession)
    rate, burst = settings.crawl_rate if rate is None else rate, settings.crawl_burst if burst is None else burst

    def make():
        state = [float(burst), None]

        def fold(times: np.ndarray, _) -> np.ndarray:
            wait, tokens, now = np.zeros(len(times)), state[0], times[0] if state[1] is None else state[1]
            for i, t in enumerate(times.tolist()):
                start = max(t, now)
                tokens, now = min(burst, tokens + (start - now) * rate), start
                if tokens < 1:
                    now += (1 - tokens) / rate
                    tokens = 1.0
                tokens -= 1
                wait[i] = now - t
            state[:] = [tokens, now]
            return np.round(wait, 6)

        return fold

    return folded(log.select(key, order, at), key, at, (order,), T.StructField("wait", T.DoubleType()), make, FOREVER)


def idle_keys(log: DataFrame, key: str, at: str, idle: float = IDLE) -> DataFrame:
    """(key, last_seen): keys whose state would have been dropped by the end of the log."""
    last = log.groupBy(key).agg(F.max(at).alias("last_seen"))
    end = log.agg(F.max(at).alias("_end"))  # one row
    gap = F.unix_micros(F.col("_end").cast("timestamp")) - F.unix_micros(F.col("last_seen").cast("timestamp"))
    return last.crossJoin(F.broadcast(end)).where(gap > idle * 1e6).drop("_end")


def recent_queries(log: DataFrame, query: str, at: str, keep: int = 8) -> DataFrame:
    """(query, last_used): the distinct trimmed queries used last."""
    one = log.select(F.trim(query).alias("query"), F.col(at).alias("at")).where("query != ''").groupBy("query").agg(F.max("at").alias("last_used"))
    return one.orderBy(F.desc("last_used"), "query").limit(keep)
