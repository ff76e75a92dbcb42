"""Embedding of texts behind one interface; the default needs no model."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.sources.tables import Settings

QUERY_PREFIX = "Represent this sentence for searching relevant passages: "


class Embedder(Protocol):
    """Made once in each worker by a factory; ``encode`` gives unit vectors of ``dimension`` numbers."""

    dimension: int

    def encode(self, texts: Sequence[str], query: bool) -> np.ndarray: ...


class HashingEmbedder:
    """Signed feature hashing of words and pairs of words: lexical, deterministic, no model. A text without words gives zeros."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def encode(self, texts: Sequence[str], query: bool = False) -> np.ndarray:
        import re

        import xxhash

        found = [re.findall(r"[^\W_]+", (t or "").lower()) for t in texts]
        # each distinct word is hashed once; pairs are hashed from the words' hashes, as whole arrays
        number = {w: i for i, w in enumerate(dict.fromkeys(w for ws in found for w in ws))}
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
        words = hashes[np.fromiter((number[w] for ws in found for w in ws), np.int64)] if number else np.empty(0, np.uint64)
        row = np.repeat(np.arange(len(texts)), [len(ws) for ws in found])
        pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ words[1:]) * np.uint64(0xD6E8FEB86659FD93) if len(words) else words
        inside = row[:-1] == row[1:]
        feature, row = np.concatenate([words, pairs[inside]]), np.concatenate([row, row[:-1][inside]])
        feature ^= feature >> np.uint64(32)
        slot = row * self.dimension + ((feature >> np.uint64(1)) % np.uint64(self.dimension)).astype(np.int64)
        out = np.bincount(slot, np.where(feature & np.uint64(1), 1.0, -1.0), len(texts) * self.dimension).reshape(-1, self.dimension).astype(np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


class ServiceEmbedder:
    """A model behind a service: ``POST url {"text": ...}`` answers ``{"embedding": [...], "dimension": n}``.

    A blank text is not sent and gives zeros. What is no answer within ``timeout`` seconds, or none with status 200, is
    asked again up to ``retries`` times, each after twice the pause before; then the call fails, and with it the batch.
    """

    def __init__(self, url: str, dimension: int, timeout: float = 30.0, retries: int = 2, pause: float = 0.5, prefix: str = QUERY_PREFIX) -> None:
        self.url, self.dimension, self.timeout, self.retries, self.pause, self.prefix = url, dimension, timeout, retries, pause, prefix

    def _ask(self, text: str) -> np.ndarray:
        import json
        import time
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        request = Request(self.url, json.dumps({"text": text}).encode(), {"Content-Type": "application/json"})
        for turn in range(self.retries + 1):
            try:
                with urlopen(request, timeout=self.timeout) as answer:
                    vector = np.asarray(json.load(answer)["embedding"], np.float32)
                if vector.shape != (self.dimension,):
                    raise ValueError(f"{vector.shape} numbers instead of {self.dimension}")
                return vector
            except (HTTPError, URLError, TimeoutError, KeyError) as e:
                if turn == self.retries or isinstance(e, HTTPError) and e.code == 400:
                    raise RuntimeError(f"no embedding: {e}") from e
                time.sleep(self.pause * 2**turn)
        raise AssertionError

    def encode(self, texts: Sequence[str], query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float32)
        for i, text in enumerate(texts):
            if text and text.strip():
                out[i] = self._ask((self.prefix if query else "") + text)
        return out


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding", factory=HashingEmbedder, query: bool = False, batch: int | None = None) -> DataFrame:
    """The rows with a column of unit vectors; null texts give null.

    A query takes the instruction prefix if the model wants one. The model sees ``batch`` texts at a time (the
    session's ``spark.fathom.embed_batch`` if none are named); a batch that fails gives null vectors for its own texts.
    """
    step = Settings.of(df.sparkSession).embed_batch if batch is None else batch

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for part in parts:
            texts, out = part.tolist(), []
            for at in range(0, len(texts), step):
                some = texts[at : at + step]
                try:
                    vectors = model.encode([t or "" for t in some], query)
                except RuntimeError:  # the service failed: keyword search still answers
                    vectors = [None] * len(some)
                out += [None if t is None else v for t, v in zip(some, vectors)]
            yield pd.Series(out, index=part.index)

    return df.withColumn(out_col, run(text_col))
