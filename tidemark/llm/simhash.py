"""Near-duplicate detection with SimHash and a Gray-order hierarchical index.

Fingerprints. A document gets a 64-bit SimHash of its distinct words, where long words count more, and a
128-bit SimHash of its distinct pairs of neighbouring words. Two documents are near copies if the first differ
in at most ``radius`` bits and the second in at most ``confirm_radius``.

Index. Equal fingerprints are folded into one first, so thousands of exact copies cost one entry. The 64 bits are
cut into more segments than the radius has bits, and read as a ring: from whatever segment one starts, the entries in
Gray order of the bits so rotated form a tree. A node is a run of entries that share the first segments, and holds
that masked pattern once for all of them. The tree is joined with itself from the top: two nodes add up the
differences of their patterns, segment by segment, and both are dropped as wholes once l segments differ in more than
radius * l / segments bits. A pair within the radius keeps to that bound all the way from at least one of the
starts (the cycle lemma), so no pair is missed, however the bits that differ are spread.

Distribution. Each start's first segment, in which no difference is allowed, is the key that sends entries to a task;
where that leaves groups of more than ``GROUP_ROWS``, the second segment without one of its bits is added to the
key (two patterns one bit apart share such a key), and groups that are still larger are cut into blocks of
which every two meet in a task of their own. All three ways find the same pairs.

Groups are the connected components over all matches, found by alternating large-star and small-star steps; up to
``LOCAL_EDGES`` edges are joined on the driver, with the same result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import M64, checkpoint, col, kind, mix, plain, words

RADIUS, CONFIRM_RADIUS = 12, 32
GROUP_ROWS, LOCAL_EDGES, BROADCAST_IDS = 1 << 19, 2_000_000, 2_000_000
LANES = M64(0x0101010101010101)
PAIRS, HELD_ROWS, NEIGHBOURS = 1 << 16, 1 << 17, 8


# -- fingerprints ---------------------------------------------------------------------------------------------


def _bit_sums(h: np.ndarray, weight: np.ndarray | None, starts: np.ndarray) -> np.ndarray:
    """For each segment of h that begins at starts, the weighted count of ones at each of the 64 bits.

    Eight shifts spread the bits over byte lanes, and lanes are added as whole 64-bit words in runs that are too
    short to overflow a lane.
    """
    n, most = len(h), 255 if weight is None else 255 // 7
    ends = np.append(starts[1:], n)
    runs = [np.arange(s, e, most) for s, e in zip(starts, ends)]
    cuts, owner = np.concatenate(runs), np.repeat(np.arange(len(starts)), [len(r) for r in runs])
    out = np.empty((len(starts), 64), np.int64)
    first = np.searchsorted(owner, np.arange(len(starts)))
    for s in range(8):
        lanes = (h >> M64(s)) & LANES
        if weight is not None:
            lanes = lanes * weight
        part = np.add.reduceat(lanes, cuts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[:, s::8] = np.add.reduceat(part, first, axis=0)
    return out


def _pack(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Bit i is set where the ones outweigh the zeros."""
    return np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def _word_hash(w: str) -> int:
    """A hash whose low three bits are the word's weight."""
    return xxhash.xxh3_64_intdigest(w) & ~7 | min(max(len(w) - 2, 1), 7)


def fingerprints(texts: list[str]) -> np.ndarray:
    """Three 64-bit words for each text: its words, then 128 bits of its neighbouring pairs.

    A text without any word gets bits from a hash of itself, so that only its exact copies match it.
    """
    cache: dict[str, int] = {}
    out = np.zeros((len(texts), 3), np.uint64)
    uni, wt, pair, at, us, ps = [], [], [], [], [0], [0]
    for i, text in enumerate(texts):
        tokens = words(text)
        if not tokens:
            for k in range(3):
                out[i, k] = xxhash.xxh3_64_intdigest(text, seed=k + 1)
            continue
        hs = np.fromiter((cache.get(w) or cache.setdefault(w, _word_hash(w)) for w in tokens), np.uint64, len(tokens))
        u = np.unique(hs)
        with np.errstate(over="ignore"):
            p = np.unique(hs[:-1] * M64(0x9E3779B97F4A7C15) + hs[1:]) if len(hs) > 1 else hs
        uni.append(u)
        pair.append(p)
        at.append(i)
        us.append(us[-1] + len(u))
        ps.append(ps[-1] + len(p))
    if not at:
        return out
    u, p, us, ps = np.concatenate(uni), mix(np.concatenate(pair)), np.array(us), np.array(ps)
    wt = u & M64(7)
    out[at, 0] = _pack(_bit_sums(mix(u), wt, us[:-1]), np.add.reduceat(wt, us[:-1]).astype(np.int64))
    out[at, 1] = _pack(_bit_sums(p, None, ps[:-1]), np.diff(ps))
    out[at, 2] = _pack(_bit_sums(mix(p ^ M64(0xD6E8FEB86659FD93)), None, ps[:-1]), np.diff(ps))
    return out


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about so many bytes of text, which bounds the memory of a step."""
    size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most)))
        yield batch.slice(at, end - at)
        at = end


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _slices(batch, 1 << 22):
            f = fingerprints(part.column(1).to_pylist()).view(np.int64)
            columns = [part.column(0), *(pa.array(f[:, k]) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "f0", "f1", "f2"])


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, f0, f1, f2) of every row that has both an id and a text."""
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("t"))
    rows = rows.filter("id IS NOT NULL AND t IS NOT NULL")
    return rows.mapInArrow(_fingerprint_batches, f"id {kind(rows, 'id')}, f0 long, f1 long, f2 long")


# -- the index ------------------------------------------------------------------------------------------------


def segments(radius: int) -> list[int]:
    """The widths of the ring's segments: one more than the radius, and no wider than a byte."""
    return np.diff(np.linspace(0, 64, max(radius + 1, 8) + 1).astype(int)).tolist()


def rotated(f: np.ndarray, start: int, widths: list[int]) -> np.ndarray:
    """The words with the segment `start` on top."""
    by = sum(widths[:start])
    return (f << M64(by)) | (f >> M64(64 - by)) if by else f


def gray_rank(f: np.ndarray) -> np.ndarray:
    """The place of each word in the reflected Gray sequence: neighbours there differ in one bit."""
    f = f.copy()
    for s in (1, 2, 4, 8, 16, 32):
        f ^= f >> M64(s)
    return f


def _near(f: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, confirm: int) -> np.ndarray:
    """Which of the pairs are near copies."""
    hit = np.flatnonzero(np.bitwise_count(f[a, 0] ^ f[b, 0]) <= radius)
    a, b = a[hit], b[hit]
    further = np.bitwise_count(f[a, 1] ^ f[b, 1]) + np.bitwise_count(f[a, 2] ^ f[b, 2])
    return hit[further <= confirm]


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels (each the least place of its component) once all pairs of a and b are connected."""
    while len(a):
        x, y = label[a], label[b]
        some = x != y
        a, b, x, y = a[some], b[some], x[some], y[some]
        if not len(a):
            break
        up = np.arange(len(label))
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, following := up[up]):
            up = following
        label = up[label]
    return label


def _cross(first_a, n_a, first_b, n_b) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For all places in pairs of ranges, about PAIRS at a time: the pairs and the places in the first ranges, how
    often each of these comes, and the places in the second ranges."""
    row = np.repeat(np.arange(len(n_a), dtype=np.int32), n_a)
    if not len(row):
        return
    x = np.arange(len(row), dtype=np.int32) - np.repeat((np.cumsum(n_a) - n_a - first_a).astype(np.int32), n_a)
    n, first = n_b[row], first_b[row].astype(np.int32)
    ends = np.cumsum(n)
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)), len(row)))
    low = done = 0
    for high in cuts.tolist():
        if high == low:
            continue
        part = slice(low, high)
        back = first[part] - (ends[part] - n[part] - done).astype(np.int32)
        y = np.arange(ends[high - 1] - done, dtype=np.int32)
        y += np.repeat(back, n[part])
        yield row[part], x[part], n[part], y
        low, done = high, int(ends[high - 1])


class GrayTree:
    """Groups of entries in Gray order from one start, below nodes that hold the patterns which runs of them share.

    f and group must be sorted by group, then by the Gray rank of the rotated first word.
    """

    def __init__(self, f: np.ndarray, group: np.ndarray, start: int, radius: int, confirm: int):
        self.f, self.word, self.radius, self.confirm = f, np.ascontiguousarray(f[:, 0]), radius, confirm
        widths = segments(radius)
        code, n = rotated(f[:, 0], start, widths), len(f)
        self.bound = [radius * level // len(widths) for level in range(len(widths) + 1)]
        changes = group[1:] != group[:-1]
        self.first, self.pattern, used = [np.concatenate(([0], np.flatnonzero(changes) + 1))], [None], 0
        for w in widths[start:] + widths[:start]:
            if 2 * len(self.first[-1]) > n:
                break
            used += w
            prefix = code >> M64(64 - used)
            self.first.append(np.concatenate(([0], np.flatnonzero(changes | (prefix[1:] != prefix[:-1])) + 1)))
            self.pattern.append((prefix[self.first[-1]] & M64((1 << w) - 1)).astype(np.uint8))
        self.places = [np.append(x, n) for x in self.first]
        self.children = [np.searchsorted(b, a) for a, b in itertools.pairwise(self.places)]
        self.same_group = ~changes
        self.scanned = 0  # pairs of entries that were compared

    def _pure(self, label: np.ndarray) -> list[np.ndarray]:
        """For each node the label that all its entries have, or else -1 less its number, which no other node has."""
        out = []
        for x in self.first:
            low, high = np.minimum.reduceat(label, x), np.maximum.reduceat(label, x)
            out.append(np.where(low == high, low, -1 - np.arange(len(x))))
        return out

    def components(self) -> np.ndarray:
        """The label of each entry: the least place of its component within its group.

        Neighbours in Gray order are joined first. Two nodes all of whose entries are known to be connected are
        dropped, so a group of thousands of near copies doesn't cost all its pairs.
        """
        n = len(self.f)
        label, same = np.arange(n), np.ones(n, bool)
        for step in range(1, min(NEIGHBOURS, n - 1) + 1):
            same = same[:-1] & self.same_group[step - 1 :]
            a = np.flatnonzero(same)
            self.scanned += len(a)
            a = a[_near(self.f, a, a + step, self.radius, self.confirm)]
            label = merge(label, a, a + step)
        pure, stale, last = self._pure(label), False, len(self.first) - 1
        roots = np.arange(len(self.first[0]))
        todo = [(0, roots, roots, np.zeros(len(roots), np.uint8))]
        while todo:
            level, a, b, spent = todo.pop()
            if stale:
                pure, stale = self._pure(label), False
            open_ = ~((pure[level][a] == pure[level][b]) & (pure[level][a] >= 0))
            a, b, spent = a[open_], b[open_], spent[open_]
            kids = self.places[level] if level == last else self.children[level]
            for row, x, n, y in _cross(kids[a], kids[a + 1] - kids[a], kids[b], kids[b + 1] - kids[b]):
                if level == last:
                    self.scanned += len(y)
                    apart = np.bitwise_count(np.repeat(self.word[x], n) ^ self.word[y])
                    near = np.flatnonzero(apart <= self.radius)
                    x, y = np.repeat(x, n)[near], y[near]
                    new = (x < y) & (label[x] != label[y])
                    x, y = x[new], y[new]
                    hit = _near(self.f, x, y, self.radius, self.confirm)
                    if len(hit):
                        label, stale = merge(label, x[hit], y[hit]), True
                    continue
                pattern = self.pattern[level + 1]
                now = np.bitwise_count(np.repeat(pattern[x], n) ^ pattern[y])
                now += np.repeat(spent[row], n)
                kept = np.flatnonzero(now <= self.bound[level + 1])
                x, y, now = np.repeat(x, n)[kept], y[kept], now[kept]
                once = x <= y
                if once.any():
                    todo.append((level + 1, x[once], y[once], now[once]))
        return label


def _edges(ids: np.ndarray, f: np.ndarray, group: np.ndarray, start: np.ndarray, radius: int, confirm: int):
    """(least id of the component, other id) within each group, a group having one start."""
    root, other, widths = [], [], segments(radius)
    for s in np.unique(start):
        at = np.flatnonzero(start == s)
        order = np.lexsort((f[at, 2], f[at, 1], gray_rank(rotated(f[at, 0], int(s), widths)), group[at]))
        at = at[order]
        label = GrayTree(f[at], group[at], int(s), radius, confirm).components()
        own = ids[at]
        rank = own if own.dtype.kind in "iu" else np.unique(own, return_inverse=True)[1]
        order = np.lexsort((rank, label))
        least = own[order][np.searchsorted(label[order], label)]
        root.append(least[least != own])
        other.append(own[least != own])
    return np.concatenate(root), np.concatenate(other)


def _match(radius: int, confirm: int, arrow_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            key = np.column_stack([t.column(k).to_numpy() for k in (0, 1)])
            group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]).any(axis=1))))
            f = np.column_stack([t.column(k).to_numpy() for k in (3, 4, 5)]).view(np.uint64)
            a, b = _edges(t.column(2).to_numpy(), f, group, key[:, 0] >> 40, radius, confirm)
            return pa.RecordBatch.from_arrays([pa.array(a, arrow_type), pa.array(b, arrow_type)], names=["u", "v"])

        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.flatnonzero((g != g[-1]) | (b != b[-1]))[-1]) + 1 if g[0] != g[-1] or b[0] != b[-1] else 0
            if held and last and count + last >= HELD_ROWS:  # the last group may go on in the next batch
                yield flush([*held, batch.slice(0, last)])
                held, count, batch = [], 0, batch.slice(last)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield flush(held)

    return run


def _keys(f: np.ndarray, radius: int, deep: bool) -> Iterator[np.ndarray]:
    """The keys of each entry, an array for each start (and, if deep, each bit of its second segment)."""
    widths = segments(radius)
    for s in range(len(widths)):
        code = rotated(f, s, widths)
        own, following = widths[s], widths[(s + 1) % len(widths)]
        key = (M64(s) << M64(40)) | ((code >> M64(64 - own)) << M64(24))
        if not deep:
            yield key.view(np.int64)
            continue
        second = (code >> M64(64 - own - following)) & M64((1 << following) - 1)
        for k in range(following):
            yield (key | M64(k + 1) << M64(16) | second & M64(~(1 << k) & 0xFFFF)).view(np.int64)


def _sizes(radius: int, deep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key in _keys(batch.column(0).to_numpy().view(np.uint64), radius, deep):
                g, n = np.unique(key, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "n"])

    return run


def _keyed(radius: int, deep: bool, blocks: dict[int, int]):
    """Each entry once for each of its keys and, in a group that is cut into blocks, each two blocks it is in."""
    hot = np.array(sorted(blocks), np.int64)
    cut = np.array([blocks[g] for g in hot.tolist()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(1).to_numpy().view(np.uint64)
            for key in _keys(f, radius, deep):
                n = np.ones(len(f), np.int64)
                if len(hot):
                    place = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                    n = np.where(hot[place] == key, cut[place], 1)
                at = np.repeat(np.arange(len(f)), n)
                other = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                own = (mix(f) % n.astype(np.uint64)).astype(np.int64)[at]
                block = np.minimum(own, other) * n[at] + np.maximum(own, other)
                columns = [pa.array(key[at]), pa.array(block), *(c.take(pa.array(at)) for c in batch.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "b", "id", "f0", "f1", "f2"])

    return run


def match_edges(
    entries: DataFrame, radius: int = RADIUS, confirm: int = CONFIRM_RADIUS, *, rows: int | None = None, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """(u, v) edges that span the components of each group; entries have distinct fingerprints, about `rows` of them."""
    spark = entries.sparkSession
    id_type = kind(entries, "id")
    rows = entries.count() if rows is None else rows
    deep = rows >> segments(radius)[0] > group_rows
    blocks: dict[int, int] = {}
    if rows > group_rows:  # else no group can be larger
        sizes = entries.select("f0").mapInArrow(_sizes(radius, deep), "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
        blocks = {r.g: -(-2 * r.n // group_rows) for r in sizes.filter(F.col("n") > group_rows).collect()}
    schema = f"g long, b long, id {id_type}, f0 long, f1 long, f2 long"
    keyed = entries.select("id", "f0", "f1", "f2").mapInArrow(_keyed(radius, deep, blocks), schema)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    together = keyed.repartition(tasks, "g", "b").sortWithinPartitions("g", "b")
    return together.mapInArrow(_match(radius, confirm, to_arrow_type(entries.schema["id"].dataType)), f"u {id_type}, v {id_type}")


# -- components -----------------------------------------------------------------------------------------------


def _local_components(edges: DataFrame) -> DataFrame:
    t = edges.toArrow()
    ids, at = np.unique(np.concatenate([t.column(k).to_numpy() for k in (0, 1)]), return_inverse=True)
    n = len(at) // 2
    label = merge(np.arange(len(ids)), at[:n], at[n:])
    other = np.flatnonzero(label != np.arange(len(ids)))
    columns = [pa.array(ids[other], t.column(0).type), pa.array(ids[label[other]], t.column(0).type)]
    return edges.sparkSession.createDataFrame(pa.table(columns, names=["id", "root"]), f"id {kind(edges, 'u')}, root {kind(edges, 'u')}")


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(id, root) of all but the roots: the least id that can be reached, by alternating large-star and small-star
    steps, whose number grows with the logarithm of the ids."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    edges = checkpoint(edges)
    if edges.count() <= local_edges:
        return _local_components(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.least(F.min("v").over(Window.partitionBy("u")), F.col("u"))
        large = both.select("u", "v", least.alias("m")).filter("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = low.select("u", "v", F.min("v").over(Window.partitionBy("u")).alias("m"))
        edges = small.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        edges = checkpoint(edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
        before = now


# -- the operator ---------------------------------------------------------------------------------------------


def _members(table: DataFrame, radius: int, confirm: int) -> DataFrame:
    exact = Window.partitionBy("f0", "f1", "f2")
    copies = table.select("id", F.min("id").over(exact).alias("rep"))
    entries = table.groupBy("f0", "f1", "f2").agg(F.min("id").alias("id"))
    found = match_edges(entries, radius, confirm, rows=table.count())
    stars = copies.filter("id <> rep").select(F.col("rep").alias("u"), F.col("id").alias("v"))
    return components(found.unionByName(stars))


def near_duplicate_members(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS, confirm: int = CONFIRM_RADIUS
) -> DataFrame:
    """(id, root) of every document that has near copies, the kept one (the least id) among them.

    Ids may be of any type that has an order and keep it. Rows without an id or text, and documents without near
    copies, don't appear. Rows that repeat an id are one document: it appears once. Texts without words match only
    exact copies of themselves; long texts are read whole. An empty table gives an empty result. Other columns of docs
    are never looked at, whatever their names.
    """
    near = _members(checkpoint(fingerprint_table(docs, id_col, text_col)), radius, confirm)
    return near.unionByName(near.select(F.col("root").alias("id"), "root").distinct())


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(kept_id, n_docs, doc_ids): a row for each group of two or more; see near_duplicate_members."""
    members = near_duplicate_members(docs, id_col, text_col, **how)
    groups = members.groupBy(F.col("root").alias("kept_id"))
    return groups.agg(F.count("*").cast("long").alias("n_docs"), F.sort_array(F.collect_list("id")).alias("doc_ids"))


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, radius: int = RADIUS, confirm: int = CONFIRM_RADIUS, broadcast_ids: int = BROADCAST_IDS
) -> DataFrame:
    """The rows of docs without all but one document of each group: the one with the least id stays.

    Columns and their order stay, whatever their names. Rows that repeat both id and text are left once. Rows
    without an id or without a text stay as they are. Texts are moved only for ids that repeat, and for all rows
    where more than broadcast_ids ids go. An empty table stays empty.
    """
    rows, back = plain(docs)
    k, t = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    table = checkpoint(fingerprint_table(docs, id_col, text_col))
    gone = _members(table, radius, confirm).select(F.col("id").alias("gone"))
    if gone.count() <= broadcast_ids:
        gone = F.broadcast(gone)
    rows = rows.join(gone, k == F.col("gone"), "left_anti")
    again = checkpoint(table.groupBy("id").count().filter("count > 1").select(F.col("id").alias("again")))
    n = again.count()
    if not n:
        return back(rows)
    if n <= broadcast_ids:
        again = F.broadcast(again)
    text = t.cast("string")
    repeated = rows.join(again, k == F.col("again"), "left_semi")
    once = Window.partitionBy(k, F.xxhash64(text), F.sha2(text, 256)).orderBy(F.lit(0))
    first = repeated.withColumn("r", F.row_number().over(once)).filter((F.col("r") == 1) | t.isNull()).drop("r")
    return back(rows.join(again, k == F.col("again"), "left_anti").unionByName(first))
