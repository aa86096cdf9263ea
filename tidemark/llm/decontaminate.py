"""Benchmark decontamination by greedy string tiling.

Texts are compared as words (see common.words). Windows of ``min_match`` words of each benchmark item are hashed
with a rolling Karp-Rabin hash; a document's windows that have the same hash are seeds, confirmed word by word.
Runs of seeds on one diagonal are maximal matches. Tiling marks the longest match between unmarked words of the
item and the document again and again, cutting what is left of others, until none of ``min_match`` words remains.
A document is contaminated if the tiles cover at least ``coverage`` of some item's words, in whatever order they
stand. Items shorter than ``min_match`` words must occur as a whole.

Texts that repeat themselves have as many seeds as the product of their lengths. Beyond ``SEEDS`` of them for an item
and a document they are not spread out: the longest match between unmarked words is then searched by its length,
with hashes of windows of that length, again and again. Both ways give the same tiles.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import M64, col, kind, mix, words

MIN_MATCH, COVERAGE, INDEX_WORDS = 3, 0.5, 4_000_000
SEEDS, SLICE_BYTES = 200_000, 1 << 25
BASE = M64(0x100000001B3)


def rolling(ids: np.ndarray, m: int) -> np.ndarray:
    """The Karp-Rabin hash of every window of m ids, modulo 2**64."""
    n = len(ids) - m + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    x = ids.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            h = h * BASE + x[j : j + n]
    return h


def tiles(matches: list[tuple[int, int, int]], m: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of maximal matches (item place, document place, length): the longest first, ties by the
    place in the item, then in the document. No word of either is in two tiles."""
    heap = [(-n, p, d) for p, d, n in matches]
    heapq.heapify(heap)
    in_item: set[int] = set()
    in_doc: set[int] = set()
    out = []
    while heap:
        n, p, d = heapq.heappop(heap)
        n = -n
        free = [p + j not in in_item and d + j not in in_doc for j in range(n)]
        if all(free):
            out.append((p, d, n))
            in_item.update(range(p, p + n))
            in_doc.update(range(d, d + n))
            continue
        start = None
        for j in range(n + 1):
            if j < n and free[j]:
                start = j if start is None else start
            elif start is not None:
                if j - start >= m:
                    heapq.heappush(heap, (start - j, p + start, d + start))
                start = None
    return out


def runs(p: np.ndarray, q: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """The maximal matches (item place, document place, length) that seeds of m words make."""
    order = np.lexsort((p, q - p))
    p, q = p[order], q[order]
    cut = np.flatnonzero((np.diff(q - p) != 0) | (np.diff(p) != 1)) + 1
    a, b = np.concatenate(([0], cut)), np.concatenate((cut, [len(p)]))
    return [(int(p[i]), int(q[i]), int(k - i) + m - 1) for i, k in zip(a, b) if k > i]


class _Windows:
    """Karp-Rabin hashes of all windows of any length over one text, and which of its words are marked."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.marks = ids, np.zeros(len(ids), bool)
        x = mix(ids.astype(np.uint64))
        self.sums, self.powers = np.zeros(len(x) + 1, np.uint64), np.ones(len(x) + 1, np.uint64)
        with np.errstate(over="ignore"):
            self.powers[1:] = np.cumprod(np.full(len(x), BASE))
            self.sums[1:] = np.cumsum(x * self.powers[1:])

    def free(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, hashes) of the windows of n words none of which is marked. Hashes are taken to one power."""
        taken = np.concatenate(([0], np.cumsum(self.marks)))
        at = np.flatnonzero(taken[n:] == taken[:-n]) if n <= len(self.ids) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            return at, (self.sums[at + n] - self.sums[at]) * self.powers[-1 - at]


def long_tiles(item: np.ndarray, doc: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """The tiles of two sequences of word numbers, found by length; 0 is a word that never matches."""
    doc = doc.copy()
    doc[doc == 0] = -1
    whole = np.concatenate((item, doc))
    # One text over both keeps the powers of their hashes apart by places alone.
    x = _Windows(whole)
    size, out = len(item), []

    def common(n: int) -> tuple[int, int] | None:
        at, h = x.free(n)
        inside = at <= size - n
        p, hp, d, hd = at[inside], h[inside], at[at >= size], h[at >= size]
        order = np.argsort(hd, kind="stable")
        hd, d = hd[order], d[order]
        k = np.minimum(np.searchsorted(hd, hp), max(len(hd) - 1, 0))
        for j in np.flatnonzero(hd[k] == hp).tolist() if len(hd) else ():
            for q in d[k[j] : np.searchsorted(hd, hp[j], side="right")].tolist():
                if np.array_equal(whole[p[j] : p[j] + n], whole[q : q + n]):  # equal hashes are only a hint
                    return int(p[j]), int(q - size)
        return None

    most = min(size, len(doc))
    while most >= m:
        low, high, best = m, most, None
        while low <= high:
            n = (low + high) // 2
            found = common(n)
            if found:
                best, low = (*found, n), n + 1
            else:
                high = n - 1
        if best is None:
            break
        p, d, most = best
        out.append(best)
        x.marks[p : p + most] = x.marks[size + d : size + d + most] = True
    return out


class Index:
    """The benchmark: its vocabulary, its items as word numbers and the windows of each by their hash."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int):
        self.vocabulary: dict[str, int] = {}
        self.ids, self.items = [], []
        for item_id, text in items:
            w = words(text)
            if w:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary) + 1) for x in w], np.int64))
        self.seeds = {}
        lengths = [min(min_match, len(x)) for x in self.items]
        for m in sorted(set(lengths)):
            at = [k for k, n in enumerate(lengths) if n == m]
            h = [rolling(self.items[k], m) for k in at]
            key, item = np.concatenate(h), np.repeat(at, [len(x) for x in h])
            place = np.concatenate([np.arange(len(x)) for x in h])
            order = np.argsort(key, kind="stable")
            self.seeds[m] = key[order], item[order], place[order]

    def _candidates(self, doc: np.ndarray, m: int, least: float) -> Iterator[tuple[int, np.ndarray | None, np.ndarray | None]]:
        """(item, places in the item, places in the document) of the seeds of m words of each item that seeds can
        cover far enough, without the places where there are too many."""
        key, item, place = self.seeds[m]
        known = doc > 0
        here = known[: len(doc) - m + 1].copy()
        for j in range(1, m):
            here &= known[j : len(doc) - m + 1 + j]
        at = np.flatnonzero(here)
        if not len(at):
            return
        h, which, often = np.unique(rolling(doc, m)[at], return_inverse=True, return_counts=True)
        low, high = np.searchsorted(key, h), np.searchsorted(key, h, side="right")
        some = high > low
        n = (high - low)[some]
        k = np.repeat(low[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)  # windows of the benchmark
        often = np.repeat(often[some], n)  # and how often the document has them
        by_hash = np.argsort(which, kind="stable")
        ends = np.cumsum(np.bincount(which, minlength=len(h)))
        hashes = np.repeat(np.flatnonzero(some), n)
        order = np.lexsort((place[k], item[k]))
        k, often, hashes = k[order], often[order], hashes[order]
        cuts = np.flatnonzero(np.diff(item[k])) + 1
        for s, e in zip(np.concatenate(([0], cuts)), np.concatenate((cuts, [len(k)]))):
            if s == e:
                continue
            number, p = int(item[k[s]]), place[k[s:e]]
            x = self.items[number]
            reach = np.zeros(len(x) + 1, np.int64)  # what all seeds together reach bounds what tiles can cover
            reach[p] += 1
            reach[p + m] -= 1
            if np.count_nonzero(np.cumsum(reach)) < least * len(x):
                continue
            n = often[s:e]
            if n.sum() > SEEDS:
                yield number, None, None
                continue
            first = ends[hashes[s:e]] - n
            q = at[by_hash[np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]]
            p = np.repeat(p, n)
            same = np.ones(len(p), bool)  # equal hashes are only a hint
            for j in range(m):
                same &= x[p + j] == doc[q + j]
            yield number, p[same], q[same]

    def covered(self, text: str | None, least: float) -> list[tuple[int, float]]:
        """(item number, share of its words in tiles) of the items that reach the least share."""
        w = words(text)
        if not w or not self.items:
            return []
        get = self.vocabulary.get
        doc = np.fromiter((get(x, 0) for x in w), np.int64, len(w))
        out = []
        for m in self.seeds:
            if len(doc) < m:
                continue
            for k, p, q in self._candidates(doc, m, least):
                x = self.items[k]
                if p is None:
                    found = long_tiles(x, doc, m)
                else:
                    found = tiles(runs(p, q, m), m)
                share = sum(n for _, _, n in found) / len(x)
                if share >= least:
                    out.append((k, share))
        return out

def _indexes(benchmark: DataFrame, item_col: str, text_col: str, min_match: int, index_words: int) -> list:
    """Broadcast indexes over parts of the benchmark, none of more than about index_words words."""
    rows = benchmark.select(col(item_col).alias("i"), col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.regexp_count("t", F.lit(r"\w+"))), F.lit(0))).first()[0]
    parts = max(1, -(-total // index_words))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    sc = benchmark.sparkSession.sparkContext
    out = []
    for k in range(parts):  # the driver holds one at a time
        items = sorted(map(tuple, rows.filter(part == k).collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))
        out.append(sc.broadcast(Index(items, min_match)))
    return out


def _each(indexes: list) -> Iterator[Index]:
    """The indexes one after another; of several, only one is in memory."""
    for index in indexes:
        yield index.value if len(indexes) == 1 else index.load_from_path(index._path)


def _held(batches: Iterator[pa.RecordBatch], alone: bool) -> Iterator[pa.Table]:
    """Batches as they come or, where going through the indexes takes time, together up to SLICE_BYTES."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if alone or size >= SLICE_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _best(indexes: list, texts: list[str | None], coverage: float) -> tuple[list[int], list[float], list]:
    """For each text, how many items it covers far enough, the largest share and its item."""
    hits, best, item = [0] * len(texts), [0.0] * len(texts), [None] * len(texts)
    for index in _each(indexes):
        for r, text in enumerate(texts):
            for k, share in index.covered(text, coverage):
                own, held = index.ids[k], item[r]
                if not hits[r] or share > best[r] or share == best[r] and own is not None and (held is None or own < held):
                    best[r], item[r] = share, own
                hits[r] += 1
    return hits, best, item


def _scan(indexes: list, coverage: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _held(batches, len(indexes) == 1):
            hits, best, item = _best(indexes, rows.column(1).to_pylist(), coverage)
            found = [rows.column(0), pa.array([n > 0 for n in hits]), pa.array(hits, pa.int64()), pa.array(best, pa.float64())]
            names = ["doc_id", "contaminated", "n_items", "coverage", "item_id"]
            yield from pa.table([*found, pa.array(item, item_type)], names=names).combine_chunks().to_batches()

    return run


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, index_words: int = INDEX_WORDS,
) -> DataFrame:
    """(doc_id, contaminated, n_items, coverage, item_id) for every row of docs, in place: nothing is shuffled.

    n_items counts the items that the row covers far enough, coverage is the largest share among them (0 without
    any) and item_id its item, ties to the least id. Ids of both keep their type. Rows without a text, and texts without
    words, are clean; long texts are read whole; rows without an id and repeated rows get rows of their own; items without
    words cover nothing. Empty docs give an empty result, an empty benchmark leaves all clean. Other columns are never
    looked at, whatever their names. A benchmark of more than index_words words is taken in parts, each task
    loading one after another, with the same result.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t"))
    indexes = _indexes(benchmark, item_col, item_text_col, min_match, index_words)
    schema = f"doc_id {kind(docs, id_col)}, contaminated boolean, n_items long, coverage double, item_id {kind(benchmark, item_col)}"
    return rows.mapInArrow(_scan(indexes, coverage, to_arrow_type(benchmark.schema[item_col].dataType)), schema)


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", *,
    min_match: int = MIN_MATCH, coverage: float = COVERAGE, index_words: int = INDEX_WORDS,
) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns; see contamination."""
    indexes = _indexes(benchmark, item_col, item_text_col, min_match, index_words)

    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([not n for n in _best(indexes, text.tolist(), coverage)[0]], dtype=bool)

    return docs.filter(clean(col(text_col).cast("string")))
