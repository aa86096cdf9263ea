"""Tasks follow the input, whatever number of them is set."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import layout
from tidemark.operators import upsert
from tidemark.plans import queries as q
from tidemark.sources import star

from .conftest import SF, same


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    """Folders with one and four copies of the line items, keys shifted."""
    folders = []
    lines = spark.read.parquet(f"{SF}/lineitem.parquet")
    for copies in (1, 4):
        folders.append(str(tmp_path_factory.mktemp(f"x{copies}")))
        many = lines.crossJoin(spark.range(copies)).withColumn("l_orderkey", F.col("l_orderkey") + F.col("id") * 1_000_000).drop("id")
        many.coalesce(1).write.parquet(f"{folders[-1]}/lineitem.parquet")
    return folders


def _largest(df) -> int:
    return max(df.rdd.glom().map(len).collect())


def _of_one_user(spark, d):
    return star.numbered_activity(spark, d).withColumn("user_id", F.lit("u"))


MADE = {
    "upsert_messages": q.QUERIES["upsert_messages"], "numbered_activity": star.numbered_activity,
    "numbered": lambda s, d: upsert.numbered(star.activity(s, d).withColumn("user_id", F.lit("u")), "ts"),
    "fold_of_one_user": lambda s, d: upsert.upsert_messages(None, _of_one_user(s, d), "turn"),
}


@pytest.mark.parametrize("make", MADE.values(), ids=MADE)
def test_a_task_holds_no_more_of_a_larger_input(spark, larger, monkeypatch, make):
    monkeypatch.setattr(layout, "TASK_BYTES", 20_000)
    small, large = (make(spark, d) for d in larger)
    assert large.count() == 4 * small.count()
    assert _largest(large) < 2 * _largest(small)


def test_fold_has_one_exchange_of_its_own(spark, larger, monkeypatch):
    monkeypatch.setattr(layout, "TASK_BYTES", 20_000)
    rows = star.activity(spark, larger[1]).select("session_id", F.col("role").alias("user_id"), F.col("ts").alias("created"), F.monotonically_increasing_id().alias("order"))
    df = upsert.upsert_sessions(None, rows.withColumn("turn_count", F.lit(None).cast("int")), "order")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan


def test_layout_leaves_rows_alone(spark, duck, monkeypatch):
    for size in (2_000, 1 << 40):
        monkeypatch.setattr(layout, "TASK_BYTES", size)
        for name in ("upsert_messages", "upsert_session_batch", "upsert_events", "transcript_cursor"):
            same(q.QUERIES[name](spark, SF).toPandas(), duck.execute(q.ORACLES[name]).df())


def test_tasks(spark):
    assert [layout.tasks_for(n, 8) for n in (0, 1, 3 << 20, 32 << 20, 400 << 20, 1 << 60)] == [1, 1, 3, 8, 100, layout.MAX_TASKS]
    unknown = spark.createDataFrame([("a", 1)], "k string, v int")
    assert layout.input_bytes(unknown) is None and layout.by_key(unknown, "k") is unknown
    lines = star.table(spark, SF, "lineitem")
    size = layout.input_bytes(lines)
    assert 50_000 < size < 1_000_000 and layout.input_bytes(lines.alias("a").crossJoin(lines.alias("b"))) == 2 * size
