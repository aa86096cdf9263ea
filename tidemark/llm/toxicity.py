"""Toxicity by class-conditional Kneser-Ney models, and by expressions that keep to toxic documents.

Two interpolated Kneser-Ney models of the characters of words, one of the labelled toxic documents and one of
the ordinary ones, differ only in their highest order (``ORDER`` characters, the edges of a word included).
Below it they share one backoff distribution, made from continuation counts of both classes, so what either class has
hardly seen is judged alike. A word's evidence is its log-likelihood under the toxic model less that under the
ordinary one. It is normalised by length over windows of 1, 3, 8 and 24 words and over the whole text (a text of fewer
words is filled up with words of no evidence), so a passage of a long text counts as much as a short text.

Evidence that is spread over a document counts too, by whole words and pairs of neighbouring words: one that
``LEAST_DOCS`` toxic documents or more hold has the log-odds of toxic to ordinary documents that hold it, and a document
the sum of its ``BEST_WORDS`` best distinct ones.

Each of these measures has a bar of its own, set from the labelled documents as if they were not: windows by models
of the other half of the labelled documents, expressions without the document's own count. The bar is the one at which the share
of toxic documents missed plus ``FALSE_COST`` (for windows, which guess at words never seen, ``WINDOW_FALSE_COST``) times
the share of ordinary ones rejected is least. A document's score is the largest of its measures in units of their bars, and above 1 it is rejected.

The counts cover all labelled documents. The models are worked out where the n-grams lie; the driver and the tasks get a key
and a ratio for each n-gram and each context, however many there are (a caller may set a bound, see ``_models``).
Expressions of toxic documents are looked for in ordinary ones ``KEYS_AT_ONCE`` at a time, and all that can speak are kept.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import M64, checkpoint, col, mix, words

ORDER, WINDOWS, THRESHOLD, DISCOUNT = 5, (1, 3, 8, 24), 1.0, 0.75
BROADCAST_LABELS, MODEL_ENTRIES, CACHE_WORDS = 1_000_000, None, 600_000
LEAST_DOCS, BEST_WORDS, FALSE_COST, WINDOW_FALSE_COST, WORD_ENTRIES, BIN = 2, 2, 10, 60, None, 1 / 20
KEYS_AT_ONCE = 10_000_000
MODELS = 3  # of the first half, of the second half and of all labelled documents
EXPRESSIONS = len(WINDOWS) + 1  # the number of the measure by expressions, behind those by windows
START, END = "\x02", "\x03"


def grams(word: str) -> list[str]:
    padded = START * (ORDER - 1) + word + END
    return [padded[i : i + ORDER] for i in range(len(word) + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = tuple(Counter() for _ in range(4))
    for batch in batches:
        for text, toxic, half in zip(*(batch.column(k).to_pylist() for k in range(3))):
            seen[2 * half + toxic].update(words(text))
        if max(map(len, seen)) > CACHE_WORDS:
            yield _gram_rows(seen)
            seen = tuple(Counter() for _ in range(4))
    if any(seen):
        yield _gram_rows(seen)


def _gram_rows(seen: tuple[Counter, ...]) -> pa.RecordBatch:
    total: defaultdict[str, list[int]] = defaultdict(lambda: [0] * len(seen))
    for k, counts in enumerate(seen):
        for word, n in counts.items():
            for g in grams(word):
                total[g][k] += n
    columns = [pa.array([x[k] for x in total.values()], pa.int64()) for k in range(len(seen))]
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *columns], names=["g", *(f"n{k}" for k in range(len(seen)))])


def gram_counts(rows: DataFrame) -> DataFrame:
    """(g, n0, n1, n2, n3): how often each n-gram stands in ordinary and in toxic documents of the first and of the
    second half of labelled rows."""
    counted = rows.mapInArrow(_count, "g string, n0 long, n1 long, n2 long, n3 long")
    return counted.groupBy("g").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic") -> DataFrame:
    """(t, y, half): the text and class of every labelled document, and which half of them it is in; of several labels
    of one id the toxic one holds."""
    marks = labels.select(col(id_col).alias("id"), col(toxic_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IS NOT NULL")
    marks = marks.groupBy("id").agg(F.max("y").alias("y"))
    if labels.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t")).filter("t IS NOT NULL")
    half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("half")
    return rows.join(marks, "id").select("t", (F.col("y") > 0).cast("int").alias("y"), half)


def _word_keys(names: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(names, object), categorize=False) if len(names) else np.zeros(0, np.uint64)


class Keys:
    """Sorted keys of expressions, and a table of their low bits that passes over most others at once."""

    def __init__(self, keys: np.ndarray):
        self.sorted, self.table = np.sort(keys), np.zeros(1 << 22, bool)
        self.table[self.sorted & M64(len(self.table) - 1)] = True

    def find(self, own: np.ndarray) -> np.ndarray:
        """The place of each key, -1 for others."""
        out = np.full(len(own), -1)
        at = np.flatnonzero(self.table[own & M64(len(self.table) - 1)])
        if len(at):
            place = np.minimum(np.searchsorted(self.sorted, own[at]), len(self.sorted) - 1)
            good = self.sorted[place] == own[at]
            out[at[good]] = place[good]
        return out


def _once(owner: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of both."""
    order = np.lexsort((what, owner))
    owner, what = owner[order], what[order]
    first = np.ones(len(owner), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (what[1:] != what[:-1])
    return owner[first], what[first]


class Texts:
    """The words of some texts by number: names has the distinct ones, ids their numbers in all texts in a row."""

    def __init__(self, split: list[list[str]]):
        flat = list(chain.from_iterable(split))
        self.names = list(dict.fromkeys(flat))
        numbers = dict(zip(self.names, range(len(self.names))))
        self.ids = np.fromiter(map(numbers.__getitem__, flat), np.int64, len(flat))
        self.sizes = np.fromiter(map(len, split), np.int64, len(split))
        self.owner = np.repeat(np.arange(len(split)), self.sizes)
        self.keys = _word_keys(self.names)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """(texts, keys) of all pairs of neighbouring words of a text."""
        at = np.flatnonzero(self.owner[1:] == self.owner[:-1]) if len(self.ids) else np.zeros(0, np.int64)
        with np.errstate(over="ignore"):
            h = self.keys * M64(0x9E3779B97F4A7C15)
            return self.owner[at], mix(h[self.ids[at]] + self.keys[self.ids[at + 1]]) if len(at) else np.zeros(0, np.uint64)

    def expressions(self) -> tuple[np.ndarray, np.ndarray]:
        """(texts, keys) of the distinct words and pairs of each text."""
        owner, keys = self.pairs()
        return _once(np.concatenate((self.owner, owner)), np.concatenate((self.keys[self.ids], keys)))

    def held(self, keys: Keys) -> tuple[np.ndarray, np.ndarray]:
        """(texts, places) of the distinct words and pairs of each text that are among keys."""
        words_ = keys.find(self.keys)[self.ids] if len(self.ids) else self.ids
        owner, own = self.pairs()
        pairs = keys.find(own)
        at, also = np.flatnonzero(words_ >= 0), np.flatnonzero(pairs >= 0)
        return _once(np.concatenate((self.owner[at], owner[also])), np.concatenate((words_[at], pairs[also])))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[Texts]:
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for i in range(0, len(texts), 500):
            yield Texts([words(t) for t in texts[i : i + 500]])


def _toxic_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many documents have each expression."""
    for texts in _texts(batches):
        w, n = np.unique(texts.expressions()[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n1"])


def _ordinary_keys(keys):
    """How many documents have each of these expressions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(keys.value.sorted), np.int64)
        for texts in _texts(batches):
            found, times = np.unique(texts.held(keys.value)[1], return_counts=True)
            n[found] += times
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(keys.value.sorted[at].view(np.int64)), pa.array(n[at])], names=["w", "n0"])

    return run


def _most_toxic(held: DataFrame, room: int) -> DataFrame:
    """As many expressions as there is room for: those in the fewest toxic documents go together."""
    least = None
    for n1, n in sorted(((r[0], r[1]) for r in held.groupBy(F.least("n1", F.lit(10_000))).count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        least = n1
    return held.filter(F.col("n1") >= least) if least is not None else held.limit(0)


class Vocabulary:
    """How many ordinary and toxic documents hold each expression that can speak for toxicity."""

    def __init__(self, key: np.ndarray, n0: np.ndarray, n1: np.ndarray):
        order = np.argsort(key)
        self.key, self.n0, self.n1 = key[order], n0[order].astype(np.int32), n1[order].astype(np.int32)
        self.keys = Keys(self.key)
        self.key = self.keys.sorted  # the same, held once

    def odds(self, at: np.ndarray, own: int | None = None) -> np.ndarray:
        """The log-odds of the expressions at these places, 0 for those that can't speak; own is the class of the
        document they are from, if it was counted."""
        n0, n1 = self.n0[at] - (own == 0), self.n1[at] - (own == 1)
        return np.where((n1 >= LEAST_DOCS) & (n1 > n0), np.log((n1 + 0.5) / (np.maximum(n0, 0) + 0.5)), 0.0)

    def evidence(self, new: list[str], own: int | None = None) -> dict[str, float]:
        """The log-odds of those words that have any."""
        at = self.keys.find(_word_keys(new))
        known = np.flatnonzero(at >= 0)
        return {new[i]: x for i, x in zip(known.tolist(), self.odds(at[known], own).tolist()) if x}

    def scores(self, split: list[list[str]] | Texts, own: int | None = None) -> list[float]:
        """The sum of the best expressions of each document."""
        texts = split if isinstance(split, Texts) else Texts(split)
        owner, at = texts.held(self.keys)
        x = self.odds(at, own)
        order = np.lexsort((-x, owner))
        owner, x = owner[order], x[order]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        best = rank < BEST_WORDS
        return np.bincount(owner[best], x[best], len(texts.sizes)).tolist()


def set_bar(counts: Iterable[tuple[int, int, int]], false_cost: float = FALSE_COST) -> float | None:
    """The best bar from (class, number of the bin of scores, documents); None if none is better than no bar."""
    total: defaultdict[int, list[int]] = defaultdict(lambda: [0, 0])
    for y, b, n in counts:
        total[b][y] += n
    every = [sum(x[y] for x in total.values()) for y in (0, 1)]
    if not all(every):
        return None
    bins, best, bar = sorted(total), 1.0, None
    over = list(every)
    for b, following in zip(bins, bins[1:]):
        over = [over[y] - total[b][y] for y in (0, 1)]
        cost = 1 - over[1] / every[1] + false_cost * over[0] / every[0]
        if cost < best:
            best, bar = cost, (b + following) / 2 * BIN
    return bar


def _speaking(rows: DataFrame, held: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, n0, n1) of those expressions (w, n1) that no more ordinary documents than toxic ones hold."""
    got = held.toArrow()
    key, n1 = got.column("w").to_numpy().view(np.uint64), got.column("n1").to_numpy()
    order = np.argsort(key)
    key, n1, n0 = key[order], n1[order], np.zeros(len(key), np.int64)
    if len(key):
        wanted = rows.sparkSession.sparkContext.broadcast(Keys(key))
        ordinary = rows.filter("y = 0").select("t").mapInArrow(_ordinary_keys(wanted), "w long, n0 long")
        got = ordinary.groupBy("w").agg(F.sum("n0").alias("n0")).toArrow()
        n0[np.searchsorted(key, got.column("w").to_numpy().view(np.uint64))] = got.column("n0").to_numpy()
        wanted.destroy()
    kept = n1 >= n0
    return key[kept], n0[kept], n1[kept]


def vocabulary(rows: DataFrame, word_entries: int | None = WORD_ENTRIES) -> Vocabulary:
    """The expressions of labelled rows (t, y): those of toxic documents first, then how many ordinary ones have them.

    The ordinary ones are read once for every ``KEYS_AT_ONCE`` expressions, which changes nothing in what is found. Only if a
    caller bounds the expressions, those in the fewest toxic documents go.
    """
    toxic = rows.filter("y = 1").select("t").mapInArrow(_toxic_keys, "w long, n1 long").groupBy("w").agg(F.sum("n1").alias("n1"))
    held = checkpoint(toxic.filter(F.col("n1") >= LEAST_DOCS))
    if word_entries is not None:
        held = _most_toxic(held, word_entries)
    passes = max(1, -(-held.count() // KEYS_AT_ONCE))
    parts = [_speaking(rows, held.filter(F.pmod("w", F.lit(passes)) == k)) for k in range(passes)]
    return Vocabulary(*(np.concatenate(x) for x in zip(*parts)))


def _codes(names: list[str], width: int) -> np.ndarray:
    """The characters of names of one width, a row for each."""
    return np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).reshape(len(names), width)


def _hash(codes: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of character codes."""
    h = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(codes.shape[1]):
            h = mix(h + codes[:, j].astype(np.uint64) + M64(0x9E3779B97F4A7C15))
    return h


def _discount(once: int, twice: int) -> float:
    return once / (once + 2 * twice) if once and twice else DISCOUNT


def _weight(total: np.ndarray, kinds: np.ndarray, d: float) -> np.ndarray:
    """The share of the backoff distribution after contexts with this many n-grams and kinds of them."""
    return np.where(total > 0, d * kinds / np.maximum(total, 1), 1.0)


def _log_p(n: np.ndarray, total: np.ndarray, kinds: np.ndarray, d: float, shared: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(n - d, 0) / np.maximum(total, 1) + _weight(total, kinds, d) * shared)


class Model:
    """The difference of the two models for each n-gram seen, and for each context seen."""

    def __init__(self, names: list[str], n0: np.ndarray, n1: np.ndarray):
        self.empty = not len(names) or not n0.sum() or not n1.sum()
        if self.empty:
            return
        self.order = len(names[0])
        codes = _codes(names, self.order)
        shared = self._shared(codes[:, 1:])
        context, at = np.unique(_hash(codes[:, :-1]), return_inverse=True)
        log_p, log_weight = [], []
        for n in (n0, n1):
            total, kinds = np.bincount(at, n, len(context)), np.bincount(at, n > 0, len(context))
            once, twice = np.count_nonzero(n == 1), np.count_nonzero(n == 2)
            d = _discount(once, twice)
            log_p.append(_log_p(n, total[at], kinds[at], d, shared))
            log_weight.append(np.log(_weight(total, kinds, d)))
        key = _hash(codes)
        order = np.argsort(key)
        self.gram, self.gram_llr = key[order], (log_p[1] - log_p[0])[order].astype(np.float32)
        self.context, self.context_llr = context, (log_weight[1] - log_weight[0]).astype(np.float32)

    @classmethod
    def of(cls, order: int, grams: pa.Table, contexts: pa.Table) -> Model:
        """The model of (key, ratio) of its n-grams and contexts; without any it is empty."""
        model = cls.__new__(cls)
        model.empty = not grams.num_rows
        if not model.empty:
            model.order = order
            model.gram, model.gram_llr = _by_key(grams)
            model.context, model.context_llr = _by_key(contexts)
        return model

    @staticmethod
    def _shared(codes: np.ndarray) -> np.ndarray:
        """The Kneser-Ney probability of each row's last character after those before it, from the kinds of
        n-grams that end in it. codes has a row for each distinct longer n-gram, without its first character."""
        levels = []
        while codes.shape[1]:
            key, first, back, kinds = np.unique(_hash(codes), return_index=True, return_inverse=True, return_counts=True)
            levels.append((codes[first], back, kinds))
            codes = codes[first][:, 1:]
        p = np.zeros(1)
        back_up = None
        for own, back, kinds in reversed(levels):
            if own.shape[1] == 1:
                lower = np.full(len(own), 1 / (len(own) + 1))  # one more for what was never seen
            else:
                lower = p[back_up]
            context, at = np.unique(_hash(own[:, :-1]), return_inverse=True)
            total, types = np.bincount(at, kinds), np.bincount(at)
            p = (kinds - DISCOUNT) / total[at] + DISCOUNT * types[at] / total[at] * lower
            back_up = back
        return p[back_up]

    def evidence(self, new: list[str]) -> list[float]:
        """The log-likelihood ratio of each word."""
        if self.empty or not new:
            return [0.0] * len(new)
        size = np.array([len(w) for w in new]) + self.order
        text = "".join([START * (self.order - 1) + w + END for w in new])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(size) - size
        n = size - (self.order - 1)
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        rows = np.lib.stride_tricks.sliding_window_view(codes, self.order)[at]
        out = self._look(self.context, self.context_llr, _hash(rows[:, :-1]), np.float32(0))
        out = self._look(self.gram, self.gram_llr, _hash(rows), out)
        return np.add.reduceat(out.astype(np.float64), np.cumsum(n) - n).tolist()

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], other)

    def measures(self, split: list[list[str]] | Texts, cache: dict[str, float]) -> list[list[float]]:
        """For each text, the best mean evidence of windows of each length, and the mean over the whole text."""
        texts = split if isinstance(split, Texts) else Texts(split)
        new = [w for w in texts.names if w not in cache]
        if len(cache) + len(new) > CACHE_WORDS:
            cache.clear()
            new = texts.names
        cache.update(zip(new, self.evidence(new)))
        each = np.fromiter(map(cache.__getitem__, texts.names), np.float64, len(texts.names))
        sums = np.zeros(len(texts.ids) + 1)
        np.cumsum(each[texts.ids], out=sums[1:])
        out = []
        for end, size in zip(np.cumsum(texts.sizes).tolist(), texts.sizes.tolist()):
            c = sums[end - size : end + 1]
            total = float(c[-1] - c[0])
            best = [(total if size <= n else float((c[n:] - c[:-n]).max())) / n for n in WINDOWS]
            out.append([*best, total / max(size, WINDOWS[-1])])
        return out


def _by_key(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    key, ratio = table.column(0).to_numpy().view(np.uint64), table.column(1).to_numpy()
    order = np.argsort(key)
    return key[order], ratio[order]


def _shared_p(counts: DataFrame, order: int) -> DataFrame | None:
    """(h, p0, p1, p2): what ``Model._shared`` gives for the n-grams that end in h, in each model; None if h is empty."""
    level = counts.select("g", *((F.col(f"a{m}") + F.col(f"b{m}")).alias(f"k{m}") for m in range(MODELS)))
    levels = []
    for width in range(order - 1, 0, -1):
        kinds = (F.sum((F.col(f"k{m}") > 0).cast("long")).alias(f"k{m}") for m in range(MODELS))
        level = level.groupBy(F.substring("g", 2, width).alias("g")).agg(*kinds)
        levels.append((width, level))
    lower = None
    for width, level in reversed(levels):
        within = Window.partitionBy(F.substring("g", 1, width - 1))
        if lower is not None:
            level = level.join(lower, F.substring("g", 2, width - 1) == F.col("h"))
        ps = []
        for m in range(MODELS):
            k = F.col(f"k{m}")
            total, types = F.nullif(F.sum(k).over(within), F.lit(0)), F.sum((k > 0).cast("long")).over(within)
            below = F.lit(1.0) / (types + 1) if lower is None else F.col(f"p{m}")  # one more for what was never seen
            ps.append(F.when(k > 0, (k - DISCOUNT) / total + F.lit(DISCOUNT) * types / total * below).alias(f"p{m}"))
        lower = level.select(F.col("g").alias("h"), *ps)
    return lower


def _ratios(discounts: list[tuple[float, float] | None], width: int, grams: bool):
    """(key, r0, r1, r2) from rows (g, [p0, p1, p2,] and for each model and class [how often it stands there,] how many
    n-grams and how many kinds of them its context has): the ratios of n-grams or of contexts, null where a model has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {name: batch.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(batch.schema.names) if name != "g"}
            out = []
            for m, ds in enumerate(discounts):
                at, logs = own[f"a{m}" if grams else f"ta{m}"] + own[f"b{m}" if grams else f"tb{m}"] > 0, []
                for c, d in zip("ab", ds or ()):
                    total, kinds = own[f"t{c}{m}"][at], own[f"k{c}{m}"][at]
                    logs.append(_log_p(own[f"{c}{m}"][at], total, kinds, d, own[f"p{m}"][at]) if grams else np.log(_weight(total, kinds, d)))
                ratio = np.zeros(len(at), np.float32)
                if logs:
                    ratio[at] = logs[1] - logs[0]
                out.append(pa.array(ratio, mask=~at if logs else np.ones(len(at), bool)))
            key = _hash(_codes(batch.column("g").to_pylist(), width)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), *out], names=["key", *(f"r{m}" for m in range(MODELS))])

    return run


def _models(rows: DataFrame, model_entries: int | None = MODEL_ENTRIES) -> tuple[Model, ...]:
    """The models of the first half, of the second half and of all labelled rows.

    Each is equal to ``Model`` of its n-grams, but worked out by joins, so that the driver gets no more than keys and ratios.
    Only if a caller bounds the kinds of n-grams, all counts of more go into n-grams that are a character shorter.
    """
    counts, order = checkpoint(gram_counts(rows)), ORDER
    while model_entries is not None and order > 1 and counts.count() > model_entries:
        counts = counts.groupBy(F.substring("g", 2, ORDER).alias("g")).agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(4)))
        order -= 1
    halves = [F.col(f"n{k}").alias(f"{c}{m}") for m in (0, 1) for c, k in (("a", 2 * m), ("b", 2 * m + 1))]
    counts = counts.select("g", *halves, (F.col("n0") + F.col("n2")).alias("a2"), (F.col("n1") + F.col("n3")).alias("b2"))
    names = [f"{c}{m}" for m in range(MODELS) for c in "ab"]
    of = {"s": F.sum, "o": lambda n: F.count_if(F.col(n) == 1), "w": lambda n: F.count_if(F.col(n) == 2)}
    sums = counts.agg(*(f(n).alias(k + n) for k, f in of.items() for n in names)).first()
    discounts = []
    for m in range(MODELS):
        both = sums[f"sa{m}"] and sums[f"sb{m}"]
        discounts.append(tuple(_discount(sums[f"o{c}{m}"], sums[f"w{c}{m}"]) for c in "ab") if both else None)

    context = F.substring("g", 1, order - 1)
    around = [x for n in names for x in (F.sum(n).alias("t" + n), F.count_if(F.col(n) > 0).alias("k" + n))]
    contexts = counts.groupBy(context.alias("g")).agg(*around)
    within = Window.partitionBy(context)
    seen = [x for n in names for x in (F.sum(n).over(within).alias("t" + n), F.sum((F.col(n) > 0).cast("long")).over(within).alias("k" + n))]
    shared = _shared_p(counts, order)
    if shared is None:
        grams = counts.select("*", *(F.lit(1.0).alias(f"p{m}") for m in range(MODELS)))
    else:
        grams = counts.join(shared, F.substring("g", 2, order - 1) == F.col("h")).drop("h")
    schema = "key long, r0 float, r1 float, r2 float"
    grams = checkpoint(grams.select("*", *seen).mapInArrow(_ratios(discounts, order, True), schema))
    contexts = checkpoint(contexts.mapInArrow(_ratios(discounts, order - 1, False), schema))
    return tuple(Model.of(order, *(t.select("key", f"r{m}").filter(f"r{m} IS NOT NULL").toArrow() for t in (grams, contexts))) for m in range(MODELS))


def _bars(rows: DataFrame, halves: tuple[Model, Model], found: Vocabulary) -> dict[int, float]:
    """The bar of each measure that can have one, from all labelled rows, each judged by models that don't know it."""
    shared = rows.sparkSession.sparkContext.broadcast((halves, found))

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (models, known), seen = shared.value, Counter()
        caches: tuple[dict, dict] = ({}, {})
        for batch in batches:
            texts, classes, sides = (batch.column(k).to_pylist() for k in range(3))
            for y, half in ((0, 0), (0, 1), (1, 0), (1, 1)):
                mine = [t for t, c, h in zip(texts, classes, sides) if c == y and h == half]
                for i in range(0, len(mine), 500):
                    split = Texts([words(t) for t in mine[i : i + 500]])
                    for values in zip(models[1 - half].measures(split, caches[half]), known.scores(split, y)):
                        seen.update((m, y, round(x / BIN)) for m, x in enumerate([*values[0], values[1]]))
        keys = [pa.array([k[i] for k in seen], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(list(seen.values()), pa.int64())], names=["m", "y", "b", "n"])

    counts: defaultdict[int, list] = defaultdict(list)
    for r in rows.mapInArrow(bins, "m int, y int, b int, n long").groupBy("m", "y", "b").agg(F.sum("n").alias("n")).collect():
        counts[r.m].append((r.y, r.b, r.n))
    shared.destroy()
    bars = {m: set_bar(c, FALSE_COST if m == EXPRESSIONS else WINDOW_FALSE_COST) for m, c in counts.items()}
    return {m: bar for m, bar in bars.items() if bar is not None and bar > 0}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", model_entries: int | None = MODEL_ENTRIES):
    """The broadcast model, vocabulary and bars over all labelled documents. Several labels of one id count as toxic if
    any is."""
    rows = labelled(docs, labels, id_col, text_col, toxic_col)
    *halves, model = _models(rows, model_entries)
    found = vocabulary(rows)
    return docs.sparkSession.sparkContext.broadcast((model, found, _bars(rows, tuple(halves), found)))


def score(model, text: Column) -> Column:
    """The largest of a text's measures in units of their bars; 0 for null and for texts without words."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        (windows, found, bars), cache = model.value, {}
        for s in parts:
            texts = s.tolist()
            out: list[float] = []
            for i in range(0, len(texts), 500):
                split = Texts([words(t) for t in texts[i : i + 500]])
                for values, spread in zip(windows.measures(split, cache), found.scores(split)):
                    all_ = [*values, spread]
                    out.append(max((all_[m] / bar for m, bar in bars.items()), default=0.0))
            yield pd.Series(out, dtype=float)

    return run(text)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", *, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxic_score, rejected) for every row of docs.

    Null, empty and wordless texts score 0 and stay; so does every text if the labels don't hold both classes. A score
    of just the threshold stays. Ids keep their type; rows without an id and repeated rows are scored each by itself;
    long texts are read whole; an empty table gives an empty result. Labels without an id or class are passed over.
    Other columns are never looked at, whatever their names.
    """
    model = train(docs, labels, id_col, text_col, toxic_col)
    rows = docs.select(col(id_col).alias("doc_id"), score(model, col(text_col).cast("string")).alias("toxic_score"))
    return rows.withColumn("rejected", F.col("toxic_score") > threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are not rejected, with all their columns; see toxicity."""
    model = train(docs, labels, id_col, text_col, toxic_col)
    return docs.filter(score(model, col(text_col).cast("string")) <= threshold)
