"""From messages to vectors: extract, chunk, embed.

Each distinct text is embedded once. Providers run inside mapInPandas, in sub-batches, with retries and a circuit
breaker for each task; a batch that fails leaves null vectors, never a failed job.
"""

from __future__ import annotations

import functools
import hashlib
import re
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EmbeddingFailure
from ..functions import ids, text
from ..functions.chunking import Chunker
from ..functions.counting import TokenCounter
from ..schemas import CONTENT_TYPES

RETRY_STATUS = {429, 500, 502, 503, 504}
RETRY_ERRORS = (ConnectionError, TimeoutError, OSError)


class Provider(Protocol):
    """What a source of vectors has to offer."""

    dimensions: int
    model_name: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


@dataclass(frozen=True)
class HashProvider:
    """Deterministic vectors from hashed words: offline, and the same in every process."""

    dimensions: int = 64
    model_name: str = "hashed-words"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


def status_of(error: BaseException) -> int | None:
    """The status code that an error carries, under the names that clients use."""
    for holder in (error, getattr(error, "response", None)):
        for name in ("status_code", "status", "http_status", "code"):
            value = getattr(holder, name, None)
            if isinstance(value, int):
                return value
    return None


def retry_after(error: BaseException) -> float | None:
    headers = getattr(error, "headers", None) or getattr(getattr(error, "response", None), "headers", None) or {}
    try:
        return float({k.lower(): v for k, v in dict(headers).items()}["retry-after"])
    except (KeyError, TypeError, ValueError):
        return None


@dataclass
class Breaker:
    """Opens after so many failures in a row and lets a try through once it has rested."""

    threshold: int = 5
    rest: float = 60.0
    clock: Callable[[], float] = time.monotonic
    failures: int = 0
    opened: float | None = None

    @property
    def closed(self) -> bool:
        return self.opened is None or self.clock() - self.opened >= self.rest

    def succeeded(self) -> None:
        self.failures, self.opened = 0, None

    def failed(self) -> None:
        self.failures += 1
        if self.failures >= self.threshold:
            self.opened = self.clock()

    def stats(self) -> dict:
        return {"failures": self.failures, "open": not self.closed}


def passing(error: BaseException) -> bool:
    """Whether an error may go away by itself: a lost connection, a timeout or a status that says so."""
    status = status_of(error)
    return isinstance(error, RETRY_ERRORS) or status is not None and status in RETRY_STATUS


@dataclass
class Retry:
    """Tries again what may pass. Only such failures count for the breaker: bad input doesn't speak against the
    provider."""

    attempts: int = 5
    base: float = 1.0
    most: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def run(self, call: Callable[[], list], breaker: Breaker) -> list:
        for n in range(self.attempts + 1):
            if not breaker.closed:
                raise EmbeddingFailure("the circuit is open")
            try:
                out = call()
            except Exception as e:
                if passing(e):
                    breaker.failed()
                if n == self.attempts or not passing(e):
                    raise
                wait = retry_after(e)
                self.sleep(min(self.most, self.base * 2**n) if wait is None else min(wait, self.most))
            else:
                breaker.succeeded()
                return out
        raise AssertionError


@dataclass
class Cache:
    """The vectors used last, by a hash of model and text."""

    size: int = 1000
    entries: OrderedDict = field(default_factory=OrderedDict)
    hits: int = 0
    misses: int = 0

    @staticmethod
    def key(text: str, model: str) -> str:
        return hashlib.sha256(f"{model}:{text}".encode()).hexdigest()

    def get(self, text: str, model: str):
        k = self.key(text, model)
        if k in self.entries:
            self.hits += 1
            self.entries.move_to_end(k)
            return self.entries[k]
        self.misses += 1
        return None

    def put(self, text: str, model: str, vector) -> None:
        k = self.key(text, model)
        self.entries[k] = vector
        self.entries.move_to_end(k)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def stats(self) -> dict:
        return {"size": len(self.entries), "max_size": self.size, "hits": self.hits, "misses": self.misses}


def embed_isolated(texts: Sequence[str | None], provider: Provider, batch: int = 16, truncate: Callable[[str], str] | None = None, retry: Retry | None = None, breaker: Breaker | None = None, cache: Cache | None = None) -> list[list[float] | None]:
    """A vector for each text, null for null or blank ones and for batches that failed."""
    retry, breaker, cache = retry or Retry(), breaker or Breaker(), cache or Cache(0)
    out: list[list[float] | None] = [cache.get(t, provider.model_name) if t and t.strip() else None for t in texts]
    todo = [k for k, t in enumerate(texts) if t and t.strip() and out[k] is None]
    for s in range(0, len(todo), batch):
        at = todo[s : s + batch]
        part = [truncate(texts[k]) if truncate else texts[k] for k in at]
        try:
            found = retry.run(lambda part=part: provider.embed_batch(part), breaker)
        except Exception:
            if not breaker.closed:
                break
            continue
        for k, v in zip(at, found):
            out[k] = v
            cache.put(texts[k], provider.model_name, v)
    return out


def chunked(texts: DataFrame, chunker: Chunker | None = None, keys: Sequence[str] = ("parent_id",)) -> DataFrame:
    """(keys, content_type, source_text, span_start, span_end, chunk_index, total_chunks, token_count): a row for
    each chunk of every row (keys, content_type, source_text)."""
    chunker = chunker or Chunker()
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", content_type string, source_text string, span_start int, span_end int, chunk_index int, total_chunks int, token_count int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for row in rows.itertuples(index=False):
                found = chunker.chunks(row[-1], row[-2])
                out += [(*row[:-1], t, a, b, n, len(found), c) for n, (t, a, b, c) in enumerate(found)]
            yield pd.DataFrame(out, columns=[*keys, "content_type", "source_text", "span_start", "span_end", "chunk_index", "total_chunks", "token_count"])

    return texts.select(*keys, "content_type", "source_text").mapInPandas(run, schema)


def pieces(texts: DataFrame, chunker: Chunker | None = None, keys: Sequence[str] = ("parent_id",)) -> DataFrame:
    """(keys, piece_index, piece, span_start, span_end, token_count): what a text is cut into before pieces are put
    together, at paragraphs, lines or sentences by content_type (C2-C5)."""
    chunker = chunker or Chunker()
    kinds = dict(texts.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", piece_index int, piece string, span_start int, span_end int, token_count int"

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            out = []
            for row in rows.itertuples(index=False):
                found = chunker.pieces(row[-1] or "", row[-2])
                out += [(*row[:-2], n, p.text, p.start, p.end, p.tokens) for n, p in enumerate(found)]
            yield pd.DataFrame(out, columns=[*keys, "piece_index", "piece", "span_start", "span_end", "token_count"])

    return texts.select(*keys, "content_type", "source_text").mapInPandas(run, schema)


def text_hash(text_column: Column, model: str) -> Column:
    """What tells texts of a model apart."""
    return F.sha2(F.concat(F.lit(model + ":"), text_column), 256)


def known_vectors(vectors: DataFrame, model: str) -> DataFrame:
    """(text_hash, vector) of what a model has embedded already."""
    own = vectors.filter((F.col("embedding_model") == model) & F.col("vector").isNotNull())
    return own.select(text_hash(F.col("source_text"), model).alias("text_hash"), "vector").dropDuplicates(["text_hash"])


def embedded(chunks: DataFrame, provider: Provider, known: DataFrame | None = None, batch: int = 16, truncate: Callable[[str], str] | None = None, retry: Retry | None = None) -> DataFrame:
    """chunks with a vector (null where it failed) and embedding_model.

    Distinct texts are embedded once, those in known (text_hash, vector) not at all. truncate cuts what is sent to the
    provider to the length it takes.
    """
    model = provider.model_name
    hashed = chunks.withColumn("text_hash", text_hash(F.col("source_text"), model))
    new = hashed.select("text_hash", "source_text").dropDuplicates(["text_hash"])
    if known is not None:
        new = new.join(known.select("text_hash"), "text_hash", "left_anti")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        breaker = Breaker()
        for rows in parts:
            found = embed_isolated(rows["source_text"].tolist(), provider, batch, truncate, retry, breaker)
            yield pd.DataFrame({"text_hash": rows["text_hash"], "vector": found})

    vectors = new.mapInPandas(run, "text_hash string, vector array<double>")
    if known is not None:
        vectors = vectors.unionByName(known.select("text_hash", F.col("vector").cast("array<double>").alias("vector")))
    return hashed.join(vectors, "text_hash", "left").drop("text_hash").withColumn("embedding_model", F.lit(model))


def message_vectors(messages: DataFrame, provider: Provider, chunker: Chunker | None = None, known: DataFrame | None = None, batch: int = 16, retry: Retry | None = None) -> DataFrame:
    """Vector records of all messages that have anything to embed; what is sent is cut to the chunker's limit."""
    chunker = chunker or Chunker()
    keys = ["parent_id", "user_id", "session_id", "project_slug"]
    texts = text.unpivoted(text.extracted(messages).withColumn("parent_id", F.col("id")), keys)
    cut = functools.partial(_cut, chunker.counter, chunker.limits.embed)
    rows = embedded(chunked(texts, chunker, keys), provider, known, batch, cut, retry)
    return rows.withColumn("id", ids.vector_id(F.col("parent_id"), F.col("content_type"), F.col("chunk_index")))


def _cut(counter: TokenCounter, most: int, text_: str) -> str:
    return counter.truncate(text_, most)


def type_lists(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """messages with a vector column for each content type, from the first chunk of each; null where there is none."""
    first = vectors.filter("chunk_index = 0").groupBy(F.col("parent_id").alias("id"))
    wide = first.agg(*(F.first(F.when(F.col("content_type") == c, F.col("vector")), ignorenulls=True).alias(f"{c}_vector") for c in CONTENT_TYPES))
    return messages.join(wide, "id", "left")


@dataclass
class Outcome:
    """What became of the messages of a backfill: rows, vectors stored and failed, and the first errors."""

    found: int = 0
    stored: int = 0
    failed: int = 0
    errors: list[str] = field(default_factory=list)


def outcome(vectors: DataFrame) -> DataFrame:
    """(found, stored, failed) over vector records."""
    return vectors.agg(F.count("*").alias("found"), F.count("vector").alias("stored"), F.count_if(F.col("vector").isNull()).alias("failed"))
