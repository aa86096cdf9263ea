"""How rows are dealt to tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of input for a task, and the least for one where cores would be idle; no more tasks than MAX_TASKS (blocks of a shuffle grow with their square).
TASK_BYTES, LEAST_BYTES, MAX_TASKS = 4 << 20, 1 << 20, 4096
_UNKNOWN = 1 << 62


def _bytes(plan) -> int | None:
    leaves = plan.collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return None if any(s >= _UNKNOWN for s in sizes) else sum(sizes)


def input_bytes(df: DataFrame) -> int | None:
    """The size of what df reads, not of its rows, which Spark overestimates after joins; None where a part isn't known."""
    return _bytes(df._jdf.queryExecution().optimizedPlan())


def tasks_for(size: int, cores: int) -> int:
    return min(MAX_TASKS, max(1, -(-size // TASK_BYTES), min(cores, -(-size // LEAST_BYTES))))


def by_key(df: DataFrame, *key: str) -> DataFrame:
    """df with rows of a key together, in as many tasks as its input asks for. Spark's own exchange has as many as are set
    and joins them by compressed bytes, of which sorted rows take up to twenty times as many in memory: there the share
    of a task grows with the input. Where the size isn't known, that exchange is left to Spark. Constants are no part of
    the key, as Spark takes them out of those of windows and aggregates and would deal the rows again."""
    plan = df.repartition(1, *key)._jdf.queryExecution().optimizedPlan()
    size = _bytes(plan)
    if size is None or plan.nodeName() != "RepartitionByExpression":
        return df
    by = plan.partitionExpressions()
    varying = [c for k, c in enumerate(key) if not by.apply(k).foldable()]
    return df.repartition(tasks_for(size, df.sparkSession.sparkContext.defaultParallelism), *varying) if varying else df
