"""Mixing sources to target weights by Sainte-Laguë apportionment.

Each source's documents are put in a seeded order and cut into blocks of equal tokens (``BLOCK_TOKENS``, or fewer
where a table is so small that its sources would have less than ``LEAST_BLOCKS`` each on average): a document belongs to
the block in which its first token falls, so blocks are equal up to whole documents. A source's weight is the square
root of its tokens, or the weight given for it. Of all blocks, the share ``budget`` is granted one by one to the source
with the highest quotient weight / (2 * granted + 1) that has blocks left (ties go to the first name, null last). Every
``shard_blocks`` grants in a row make a shard, so each shard has an integer quota of each source and no rounding
error adds up from shard to shard. A source's k-th grant is filled by the k-th of its blocks in a second seeded order.

No window spans the rows of a source: they are added up in hash buckets, in as many levels as keep each window to
some ten thousand rows. The order of grants is a sort by ranges over one row for each block. Of all this only one row for
each source, and one for each partition of that sort, reach the driver. Texts are tokenised once.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, col, plain

BLOCK_TOKENS, LEAST_BLOCKS, BUDGET, SHARD_BLOCKS, SEED = 16384, 64, 0.8, 16, 7
BUCKET_DIGITS, BUCKET_ROWS, BROADCAST_ROWS = 3, 10_000, 2_000_000
TOKEN = r"[^ \t\n\r\f]+"


def _hash(seed: int, *parts) -> Column:
    """The hexadecimal digest by which things are put in a seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}"), *(F.concat(F.lit(":"), F.coalesce(p.cast("string"), F.lit("null"))) for p in parts)))


def _name(z: str = "z") -> Column:
    """The source that a key stands for: keys are not null, so that rows join and group alike."""
    return F.when(F.col(z) != "0", F.substring(z, 2, 1 << 30))


def _running(rows: DataFrame, count: int, tie: str, value: str, bucket_rows: int) -> DataFrame:
    """rows (z, h, ...) with start: the sum of value over all rows of the same z that come before by (h, tie)."""
    levels = 1
    while count > bucket_rows * 16 ** (BUCKET_DIGITS * levels):
        levels += 1
    buckets = [f"b{level}" for level in range(levels)]
    rows = rows.withColumns({b: F.substring("h", 1, BUCKET_DIGITS * (level + 1)) for level, b in enumerate(buckets)})
    sums = rows.groupBy("z", *buckets).agg(F.sum(value).alias("t"))
    bases = None
    for level, b in enumerate(buckets):
        up = Window.partitionBy("z", *buckets[:level]).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
        part = sums.groupBy("z", *buckets[: level + 1]).agg(F.sum("t").alias("t")) if level + 1 < levels else sums
        part = part.select("z", *buckets[: level + 1], F.coalesce(F.sum("t").over(up), F.lit(0)).alias("own"))
        if bases is not None:
            part = part.join(bases, ["z", *buckets[:level]]).withColumn("own", F.col("own") + F.col("base")).drop("base")
        bases = part.withColumnRenamed("own", "base")
    within = Window.partitionBy("z", buckets[-1]).orderBy("h", tie).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(bases.select("z", buckets[-1], "base"), ["z", buckets[-1]])
    return placed.withColumn("start", F.col("base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("base", *buckets)


def _seats(blocks: DataFrame) -> DataFrame:
    """blocks (z, block, r, w) with their seat: their place in the order of quotients."""
    spark = blocks.sparkSession
    order = [(F.col("w") / (2 * F.col("r") + 1)).desc(), F.col("z") == "0", F.col("z"), F.col("r")]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = blocks.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    rows = rows.select("z", "block", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i"))
    rows = checkpoint(rows)
    base, before = [], 0
    for p, n in sorted(map(tuple, rows.groupBy("p").count().collect())):
        base.append((p, before))
        before += n
    return rows.join(F.broadcast(spark.createDataFrame(base, "p int, base long")), "p").select("z", "block", (F.col("base") + F.col("i")).alias("seat"))


def select_blocks(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: dict[str | None, float] | None = None,
    block_tokens: int = BLOCK_TOKENS, budget: float = BUDGET, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """(source, doc_id, n_tokens, block, shard) of every document that is selected.

    Tokens are runs of anything but blanks and line ends; long texts are counted whole. Ids keep their type. Rows that
    share source and id are one document of all their tokens. Null sources are one source; null ids of a source are
    one document; null and empty texts have no tokens and go with the document before them; a source without any
    token has no weight and is left out. Given weights leave out sources that they don't name. Equal quotients go to the
    first name. An empty table gives an empty result. Other columns are never looked at, whatever their names.
    """
    spark = docs.sparkSession
    tokens = F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("1"), col(source_col).cast("string")), F.lit("0"))
    rows = docs.select(key.alias("z"), col(id_col).alias("k"), tokens.alias("n"))
    units = checkpoint(rows.groupBy("z", "k").agg(F.sum("n").alias("n")).withColumn("h", _hash(seed, F.col("k"))))
    totals = {r.z: r.n for r in units.groupBy("z").agg(F.sum("n").alias("n")).collect()}
    each = min(block_tokens, max(1, sum(totals.values()) // max(1, LEAST_BLOCKS * len(totals))))
    names = {z: None if z == "0" else z[1:] for z in totals}
    w = {z: math.sqrt(n) if weights is None else float(weights.get(names[z], 0)) for z, n in totals.items()}
    placed = _running(units, units.count(), "k", "n", bucket_rows)
    placed = checkpoint(placed.select("z", "k", "n", F.expr(f"start div {each}").alias("block")))
    blocks = placed.select("z", "block").distinct().withColumn("h", _hash(seed, _name(), F.col("block"))).withColumn("one", F.lit(1))
    blocks = checkpoint(blocks)
    count = blocks.count()
    weight = spark.createDataFrame([x for x in w.items() if x[1] > 0], "z string, w double")
    if len(w) <= BROADCAST_ROWS:
        weight = F.broadcast(weight)
    ranked = _running(blocks, count, "block", "one", bucket_rows).withColumnRenamed("start", "r").join(weight, "z")
    seats = _seats(ranked).filter(F.col("seat") < int(Decimal(str(budget)) * count))
    chosen = seats.select("z", "block", F.expr(f"seat div {shard_blocks}").alias("shard"))
    picked = placed.join(chosen, ["z", "block"])
    return picked.select(_name().alias("source"), F.col("k").alias("doc_id"), F.col("n").alias("n_tokens"), "block", "shard")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, broadcast_rows: int = BROADCAST_ROWS, **how) -> DataFrame:
    """The rows of docs whose documents are selected, with all their columns; see select_blocks.

    Up to broadcast_rows selected documents are broadcast, so that texts stay where they are; more are joined.
    """
    rows, back = plain(docs)
    s, k = (F.col(f"c{docs.columns.index(c)}") for c in (source_col, id_col))
    chosen = checkpoint(select_blocks(docs, id_col, text_col, source_col, **how).select(F.col("source").alias("s"), F.col("doc_id").alias("k")))
    if chosen.count() <= broadcast_rows:
        chosen = F.broadcast(chosen)
    return back(rows.join(chosen, s.cast("string").eqNullSafe(F.col("s")) & k.eqNullSafe(F.col("k")), "left_semi"))


def oracle(block_tokens: int = BLOCK_TOKENS, budget: float = BUDGET, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> str:
    return f"""
WITH units AS (SELECT source AS s, doc_id AS k, CAST(sum(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r\\f]+')), 0)) AS BIGINT) AS n
  FROM documents GROUP BY 1, 2),
size AS (SELECT least({block_tokens}, greatest(1, CAST(sum(n) AS BIGINT) // ({LEAST_BLOCKS} * count(DISTINCT coalesce('1' || s, '0'))))) AS each FROM units),
started AS (SELECT s, k, n, coalesce(sum(n) OVER (PARTITION BY s ORDER BY md5('{seed}:' || coalesce(CAST(k AS VARCHAR), 'null')), k
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM units),
placed AS (SELECT s, k, n, CAST(start AS BIGINT) // CAST(each AS BIGINT) AS block FROM started, size),
blocks AS (SELECT s, block, sum(n) AS n FROM placed GROUP BY 1, 2),
ranked AS (SELECT s, block, sqrt(CAST(sum(n) OVER (PARTITION BY s) AS DOUBLE)) AS w, row_number() OVER (PARTITION BY s
  ORDER BY md5('{seed}:' || coalesce(s, 'null') || ':' || CAST(block AS VARCHAR)), block) - 1 AS r FROM blocks),
seats AS (SELECT s, block, row_number() OVER (ORDER BY w / (2 * r + 1) DESC, s ASC NULLS LAST, r) - 1 AS seat FROM ranked WHERE w > 0)
SELECT p.s AS source, p.k AS doc_id, p.n AS n_tokens, p.block AS block, CAST(seat // {shard_blocks} AS BIGINT) AS shard
FROM placed p JOIN seats x ON p.s IS NOT DISTINCT FROM x.s AND p.block = x.block
WHERE seat < floor((SELECT count(*) FROM ranked) * {budget})"""
