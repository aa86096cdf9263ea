"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

Rows are counted for each input partition, and shards are put together in ranges of up to ``RANGE_SHARDS``, one for each
partition after the exchange. The matrix of how many rows partition i sends to range j has the partition sizes as
row sums and the range sizes as column sums, and is distributed as under a uniform permutation of all rows. It is never
held as a whole: a tree over the partitions splits the range sizes between left and right halves by multivariate
hypergeometric draws seeded by the node, so each task walks one path down to its own row. A task permutes its rows
and deals them out by that row; after the exchange the rows of each range are permuted again and cut into its shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import plain

ROWS_PER_SHARD, RANGE_SHARDS, SEED = 8192, 16, 11
EXACT_COLORS = 1_000_000_000  # numpy draws from smaller populations only


def shard_sizes(rows: int, rows_per_shard: int = ROWS_PER_SHARD) -> np.ndarray:
    """Sizes that add up to rows and differ by one at most, none above rows_per_shard."""
    n = -(-rows // rows_per_shard)
    return np.array([(rows * (j + 1)) // n - (rows * j) // n for j in range(n)], np.int64)


def _draw(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of the good are in a sample without replacement.

    Beyond numpy's limit by inversion: ratios of neighbouring probabilities are added up from the mode to twelve
    standard deviations on both sides, where nothing that a double can hold is left.
    """
    if good + bad < EXACT_COLORS:
        return int(rng.hypergeometric(good, bad, sample)) if sample and good + bad else 0
    low, high, total = max(0, sample - bad), min(good, sample), good + bad
    mode = min(max((sample + 1) * (good + 1) // (total + 2), low), high)
    reach = int(12 * (sample / total * good * (bad / total) * ((total - sample) / total)) ** 0.5) + 40
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=np.float64)
    step = np.log(good - k[:-1]) + np.log(sample - k[:-1]) - np.log(k[1:]) - np.log(bad - sample + k[1:])
    log_p = np.concatenate(([0.0], np.cumsum(step)))
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return int(k[min(np.searchsorted(p, rng.random() * p[-1], side="right"), len(k) - 1)])


def split(rng: np.random.Generator, colors: np.ndarray, sample: int) -> np.ndarray:
    """How many of each color are in a sample without replacement."""
    if colors.sum() < EXACT_COLORS:
        return rng.multivariate_hypergeometric(colors, sample, method="marginals")
    out, rest = np.zeros(len(colors), np.int64), int(colors.sum())
    for k, c in enumerate(colors.tolist()):
        rest -= c
        out[k] = _draw(rng, c, rest, sample)
        sample -= int(out[k])
    return out


def matrix_row(sizes: np.ndarray, ranges: np.ndarray, at: int, seed: int = SEED) -> np.ndarray:
    """Row `at` of the matrix: how many rows partition `at` sends to each range."""
    starts = np.concatenate(([0], np.cumsum(sizes)))
    low, high, left = 0, len(sizes), ranges.astype(np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        rng = np.random.default_rng([seed, low, high])
        drawn = split(rng, left, int(starts[mid] - starts[low]))
        if at < mid:
            high, left = mid, drawn
        else:
            low, left = mid, left - drawn
    return left


def _deal(sizes, ranges, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me = TaskContext.get().partitionId()
        n = int(sizes.value[me]) if me < len(sizes.value) else 0
        rng = np.random.default_rng([seed, me, 1])
        label = np.empty(n, np.int32)
        if n:
            row = matrix_row(sizes.value, ranges.value, me, seed)
            label[rng.permutation(n)] = np.repeat(np.arange(len(row), dtype=np.int32), row)
        at = 0
        for batch in batches:
            m = batch.num_rows
            if at + m > n:
                raise RuntimeError("a partition grew between the count and the exchange: the input must be read the same way twice")
            order = rng.integers(-(1 << 63), 1 << 63, m, dtype=np.int64)
            row = np.full(m, me, np.int64) << 40 | np.arange(at, at + m)
            columns = [*batch.columns, pa.array(label[at : at + m]), pa.array(order), pa.array(row)]
            added = [pa.field("r", pa.int32()), pa.field("key", pa.int64()), pa.field("row", pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([*batch.schema, *added]))
            at += m
        if at != n:
            raise RuntimeError("a partition shrank between the count and the exchange: the input must be read the same way twice")

    return run


def shuffle_into_shards(
    rows: DataFrame, *, rows_per_shard: int = ROWS_PER_SHARD, range_shards: int = RANGE_SHARDS, seed: int = SEED, shard_col: str = "shard", position_col: str = "position"
) -> DataFrame:
    """All rows with all their columns, and in which shard (from 0) and at which place of it (from 0) each stands.

    Every row is dealt, whatever it holds: nulls, repeated rows and long texts make no difference. Shard sizes
    differ by one at most. An empty table gives no shards. If rows already has a column of the name of shard_col
    or position_col, the new one gets underscores in front until it is free. The same input layout and seed give
    the same result, also when tasks run again; the input must be read the same way twice (files are; write out
    anything else first), which each task checks.
    """
    spark = rows.sparkSession
    taken = {c.lower() for c in rows.columns}
    while shard_col.lower() in taken:
        shard_col = "_" + shard_col
    while position_col.lower() in taken | {shard_col.lower()}:
        position_col = "_" + position_col
    own, back = plain(rows)
    parts = own.rdd.getNumPartitions()
    found = dict(map(tuple, own.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*")).collect()))
    counts = np.array([found.get(k, 0) for k in range(parts)], np.int64)
    total = int(counts.sum())
    shards = shard_sizes(total, rows_per_shard)
    ranges = min(len(shards), max(-(-len(shards) // range_shards), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    first = len(shards) * np.arange(ranges + 1) // max(ranges, 1)  # shard of each range
    starts = np.concatenate(([0], np.cumsum(shards)))[first]
    sc = spark.sparkContext
    added = [T.StructField("r", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("row", T.LongType())]
    deal = _deal(sc.broadcast(counts), sc.broadcast(np.diff(starts)), seed)
    dealt = own.mapInArrow(deal, T.StructType([*own.schema.fields, *added])).repartitionById(max(1, ranges), F.col("r"))
    start = F.broadcast(spark.createDataFrame(list(enumerate(starts[:-1].tolist())), "r int, start long"))
    place = F.row_number().over(Window.partitionBy("r").orderBy("key", "row")) - 1
    placed = dealt.withColumn("place", place.cast("long")).join(start, "r").withColumn("place", F.col("start") + F.col("place"))
    n = len(shards)
    placed = placed.withColumn("shard", F.expr(f"((place + 1) * {n}L - 1) div {max(total, 1)}L"))
    placed = placed.withColumn("position", F.expr(f"place - ({total}L * shard) div {max(n, 1)}L"))
    names = [F.col(f"c{k}").alias(c) for k, c in enumerate(rows.columns)]
    return placed.select(*names, F.col("shard").alias(shard_col), F.col("position").alias(position_col))
