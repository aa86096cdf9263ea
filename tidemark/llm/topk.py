"""Exact top-k cosine neighbours of every vector, by the threshold algorithm over sorted lists.

Vectors are scaled to length one. An index keeps a list for each dimension, sorted by value. A query reads its lists
from the end that helps it (the top where its own value is positive, else the bottom) to the same depth; an
object met in any of them gets its full score. The last values read, and the length of one, bound the score of every
object not met yet. Each query stops by itself once its k-th best score beats that bound. Depths double; a query
whose bound doesn't fall low enough before it has read ``WIDE`` times as many entries as there are objects takes the
rest of the index as met, and its scores come from one matrix product with all queries of that kind. So does, from
``DOUBT`` times as many on, one whose bound even at that depth would not be below the k-th score it has by then.

Scores are first computed in single precision. Those that could be among the k best within its rounding error are then
scored in double precision and ranked by the score rounded to nine digits, then id, so ties are exact.

Queries and vectors meet in one job: vectors are cut into parts of about ``PART_ROWS``, queries into blocks, and a
task has one part and one block. It builds the part's index, and the k best of a query over all parts are merged.
No vector passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import checkpoint, col, kind

K, PART_ROWS, BATCH, DIGITS, SLACK = 10, 65536, 256, 9, 4e-6
FIRST_DEPTH, WIDE, DOUBT = 4, 0.5, 1 / 32


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; rows of zeros stay."""
    n = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(n > 0, n, 1)[:, None]


class Index:
    """Sorted lists over vectors of one dimension."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], np.ascontiguousarray(x[order])
        self.single = self.x.astype(np.float32)
        self.lists = np.argsort(self.x, axis=0, kind="stable").astype(np.int32).T  # by dimension, ascending

    def bound(self, q: np.ndarray, depth: int) -> np.ndarray:
        """What no object that is deeper than depth in all lists of a query can exceed.

        Such an object's values are at most the last ones read, and its length is at most one. The best that both allow
        is min(t * value of the query, last value) in each dimension, for the t at which the length is one; whatever t,
        the dual value is a bound.
        """
        d = np.arange(self.x.shape[1])
        low, high = self.x[self.lists[:, depth - 1], d], self.x[self.lists[:, -depth], d]
        size, last = np.abs(q), np.where(q > 0, high, np.where(q < 0, -low, np.inf))
        least, most = np.ones((len(q), 1)), np.full((len(q), 1), 1e7)
        for _ in range(32):
            t = np.sqrt(least * most)
            short = (np.minimum(t * size, last) ** 2).sum(axis=1, keepdims=True) < 1
            least, most = np.where(short, t, least), np.where(short, most, t)
        y = np.minimum(least * size, last)
        return ((size * y).sum(axis=1, keepdims=True) + (1 - (y**2).sum(axis=1, keepdims=True)) / (2 * least))[:, 0]

    def heads(self, q: np.ndarray, before: int, depth: int) -> np.ndarray:
        """The objects that each query meets in its lists behind place `before` up to `depth`; some come again."""
        n = len(self.ids)
        top, bottom = self.lists[:, n - depth : n - before], self.lists[:, before:depth]
        met = np.where((q > 0)[:, :, None], top[None], bottom[None])
        idle = np.nonzero(q == 0)  # these lists help no one; objects of another one stand in for theirs
        met[idle] = met[idle[0], np.abs(q).argmax(axis=1)[idle[0]]]
        return np.sort(met.reshape(len(q), -1), axis=1)

    def search(self, qids: np.ndarray, q: np.ndarray, k: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """Each query's (scores, ids), the best first, and how many scores were computed."""
        n, scored = len(self.ids), 0
        best = [(np.zeros(0), np.zeros(0, np.int64))] * len(q)
        kth = np.full(len(q), -np.inf)
        own = np.searchsorted(self.ids, qids, "left"), np.searchsorted(self.ids, qids, "right")
        single = q.astype(np.float32)
        lists = np.maximum((q != 0).sum(axis=1), 1)
        live, rest, before, depth = np.arange(len(q)), [], 0, min(FIRST_DEPTH, n)
        while len(live):
            wide = depth * lists[live] > WIDE * n
            doubt = np.flatnonzero(~wide & (depth * lists[live] > DOUBT * n))
            for m in np.unique(lists[live[doubt]]).tolist():
                same = doubt[lists[live[doubt]] == m]
                end = min(n, max(depth, int(WIDE * n) // m))
                wide[same] = self.bound(q[live[same]], end) >= kth[live[same]]
            rest.append(live[wide])
            live = live[~wide]
            if not len(live):
                break
            for some in _pieces(live, (depth - before) * q.shape[1] ** 2, 1 << 22):
                met = self.heads(q[some], before, depth)
                scores = np.einsum("bmd,bd->bm", self.single[met], single[some])
                again = np.zeros(met.shape, bool)
                again[:, 1:] = met[:, 1:] == met[:, :-1]
                scores[again] = -np.inf
                scored += scores.size - int(again.sum())
                for i, at, s in zip(some.tolist(), met, scores):
                    self._merge(i, q, s, at, own, best, kth, k)
            live = live[self.bound(q[live], depth) >= kth[live] - SLACK]
            before, depth = depth, 2 * depth
        at = np.arange(n)
        live = np.concatenate(rest) if rest else live
        for some in _pieces(live, n, 1 << 24):
            scores = single[some] @ self.single.T
            scored += scores.size
            for i, s in zip(some.tolist(), scores):
                self._merge(i, q, s, at, own, best, kth, k)
        return [(s, self.ids[at]) for s, at in best], scored

    def _merge(self, i: int, q: np.ndarray, scores: np.ndarray, at: np.ndarray, own: tuple, best: list, kth: np.ndarray, k: int) -> None:
        """Puts the objects `at` (ascending) into the best of query i, but for rows of the query's own id."""
        scores[slice(*np.searchsorted(at, (own[0][i], own[1][i])))] = -np.inf
        bar = kth[i]
        if len(scores) > k:
            bar = max(bar, np.partition(scores, len(scores) - k)[len(scores) - k])
        near = at[(scores >= bar - SLACK) & (scores > -np.inf)]
        near = near[~np.isin(near, best[i][1])]
        if not len(near):
            return
        s = np.concatenate((best[i][0], np.einsum("ij,j->i", self.x[near], q[i])))
        place = np.concatenate((best[i][1], near))
        order = np.lexsort((place, -np.round(s, DIGITS)))[:k]  # places are in the order of ids
        best[i] = s[order], place[order]
        if len(order) == k:
            kth[i] = s[order[-1]]  # not the least by rounding, for which SLACK makes up


def _pieces(rows: np.ndarray, each: int, most: int) -> list[np.ndarray]:
    """The rows in runs of about `most` numbers in all, of which each row has so many."""
    return np.array_split(rows, min(len(rows), -(-len(rows) * each // most))) if len(rows) else []


def _matrices(batch: pa.RecordBatch | pa.Table, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, unit vectors) for each dimension of the vectors in a column."""
    vectors = batch.column(column)
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for d in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == d)
        yield rows, unit(values[starts[rows][:, None] + np.arange(d)].astype(np.float64))


def _cells(k: int, ids: pa.DataType):
    """From rows (cell, role, id, q, v), those of the index (role 0) before the queries, to (id, q, s, n)."""

    def answers(index: dict[int, Index], batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, x in _matrices(batch, 4):
            if x.shape[1] not in index:
                continue
            own, q = batch.column(2).take(pa.array(rows)), batch.column(3).to_numpy()[rows]
            qids = own.to_numpy(zero_copy_only=False)
            for start in range(0, len(rows), BATCH):
                found, _ = index[x.shape[1]].search(qids[start : start + BATCH], x[start : start + BATCH], k)
                at = np.repeat(np.arange(len(found)), [len(s) for s, _ in found]) + start
                columns = [own.take(pa.array(at)), pa.array(q[at]), pa.array(np.concatenate([s for s, _ in found]))]
                columns.append(pa.array(np.concatenate([n for _, n in found]), ids))
                yield pa.RecordBatch.from_arrays(columns, names=["id", "q", "s", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        index: dict[int, Index] = {}
        at = None  # the cell whose index is built
        for whole in batches:
            cells, roles = whole.column(0).to_numpy(), whole.column(1).to_numpy()
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (roles[1:] != roles[:-1])) + 1
            for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if low == high:
                    continue
                batch, cell = whole.slice(low, high - low), cells[low]
                if roles[low] == 0:
                    if held and held[0].column(0)[0].as_py() != cell:
                        held = []
                    held.append(batch)
                    continue
                if cell != at:
                    index, at = {}, cell
                    if held and held[0].column(0)[0].as_py() == cell:
                        part = pa.Table.from_batches(held)
                        own = part.column(2).to_numpy()
                        index = {x.shape[1]: Index(own[rows], x) for rows, x in _matrices(part, 4)}
                    held = []
                yield from answers(index, batch)

    return run


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = K, part_rows: int = PART_ROWS) -> DataFrame:
    """(vec_id, rank, neighbor_id, score): the k nearest others of every vector by cosine, ranks from 1.

    Scores are compared rounded to nine digits and given rounded to six; ties go to the least id. Ids may be of any
    type that has an order and keep it. Rows without an id, and vectors that are null, empty, or hold nulls or anything
    but finite numbers, are left out. A vector of zeros scores 0 with all others. Only vectors of the same dimension are
    compared. Rows that repeat an id and vector are one; no vector is its own neighbour, nor is another one of the
    same id. With k or fewer others, all of them come. An empty table gives an empty result, and other columns are
    never looked at, whatever their names.
    """
    spark = vectors.sparkSession
    v = col(vector_col).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(col(id_col).isNotNull() & fine).select(col(id_col).alias("id"), v.alias("v")).distinct()
    rows = checkpoint(rows.withColumn("q", F.monotonically_increasing_id()))
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = rows.count()
    parts = max(1, -(-total // part_rows))
    blocks = max(parts, min(-(-tasks // parts), -(-total // BATCH)))
    part, block = (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int") for seed, n in ((0, parts), (1, blocks)))
    index = rows.select(part.alias("p"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), F.lit(0).alias("role"), "id", "q", "v")
    asked = rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"), block.alias("b"), F.lit(1).alias("role"), "id", "q", "v")
    cell = (F.col("p").cast("long") * blocks + F.col("b")).alias("cell")
    both = index.unionByName(asked).select(cell, "role", "id", "q", "v")
    spread = min(parts * blocks, max(tasks, 10_000))
    met = both.repartitionById(spread, F.pmod("cell", F.lit(spread)).cast("int")).sortWithinPartitions("cell", "role")
    id_type = kind(rows, "id")
    found = met.mapInArrow(_cells(k, to_arrow_type(rows.schema["id"].dataType)), f"id {id_type}, q long, s double, n {id_type}")
    order = Window.partitionBy("q").orderBy(F.round("s", DIGITS).desc(), "n")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), "rank", F.col("n").alias("neighbor_id"), F.round("s", 6).alias("score"))


def oracle(k: int = K) -> str:
    return f"""
WITH v AS (SELECT DISTINCT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT id, x, sqrt(list_inner_product(x, x)) AS n FROM v),
pairs AS (SELECT a.id AS vec_id, b.id AS neighbor_id,
  CASE WHEN a.n = 0 OR b.n = 0 THEN 0.0 ELSE list_inner_product(a.x, b.x) / (a.n * b.n) END AS s FROM u a JOIN u b ON a.id <> b.id),
ranked AS (SELECT vec_id, neighbor_id, s, row_number() OVER (PARTITION BY vec_id ORDER BY round(s, 9) DESC, neighbor_id) AS r FROM pairs)
SELECT vec_id, CAST(r AS INTEGER) AS rank, neighbor_id, round(s, 6) AS score FROM ranked WHERE r <= {k}"""
