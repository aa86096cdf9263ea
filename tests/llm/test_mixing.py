import random

import duckdb

from tidemark.llm import mixing as m

from ..conftest import same


def greedy(w, blocks, seats):
    got = [0] * len(w)
    for _ in range(seats):
        free = [k for k in range(len(w)) if got[k] < blocks[k] and w[k] > 0]
        if not free:
            break
        got[max(free, key=lambda k: (w[k] / (2 * got[k] + 1), -k))] += 1
    return got


def test_grants_come_in_the_order_of_the_greedy_rule(spark):
    rng = random.Random(0)
    for n in (1, 3, 7):
        w = [rng.choice([1, 1, 2, 3.5, rng.random() * 10]) for _ in range(n)]
        blocks = [rng.randint(1, 30) for _ in range(n)]
        rows = [(f"1{k}", b, b, float(w[k])) for k in range(n) for b in range(blocks[k])]
        seats = m._seats(spark.createDataFrame(rows, "z string, block long, r long, w double")).collect()
        assert sorted(r.seat for r in seats) == list(range(sum(blocks)))
        for most in (0, 1, 5, sum(blocks) // 2, sum(blocks)):
            assert [sum(r.z == f"1{k}" and r.seat < most for r in seats) for k in range(n)] == greedy(w, blocks, most)


def test_running_sums_in_any_number_of_levels(spark):
    rng = random.Random(1)
    rows = [(f"1{k % 3}", f"{rng.randrange(1 << 128):032x}", k, rng.randint(0, 9)) for k in range(500)]
    want = {k: sum(v for y, g, _, v in rows if y == z and g < h) for z, h, k, _ in rows}
    for bucket_rows in (10_000, 0.05, 0.00001):
        got = m._running(spark.createDataFrame(rows, "z string, h string, k long, n long"), 500, "k", "n", bucket_rows)
        assert {r.k: r.start for r in got.collect()} == want


def test_equals_sql(spark, awkward):
    con = duckdb.connect()
    for docs in (awkward, awkward.filter("doc_id = -1")):
        table = docs.select("doc_id", "text", "source").toArrow()
        con.register("documents", table)
        for how in ({}, {"block_tokens": 3, "shard_blocks": 2, "budget": 0.5}, {"block_tokens": 100, "budget": 1.0}):
            same(m.select_blocks(docs, **how).toPandas(), con.execute(m.oracle(**how)).df())


def test_mix_keeps_rows_and_columns(spark, awkward, nothing):
    everything = m.mix(awkward, budget=1.0)
    assert everything.columns == awkward.columns
    assert everything.count() == awkward.filter("source IS NOT NULL").count()  # the null source has no token
    assert m.mix(awkward, budget=1.0, weights={"s0": 1.0}).filter("source = 's0'").count() == everything.filter("source = 's0'").count()
    assert m.mix(nothing).count() == 0
    few = m.mix(awkward, block_tokens=100, broadcast_rows=0)
    assert sorted(map(str, few.collect())) == sorted(map(str, m.mix(awkward, block_tokens=100).collect()))


def test_ids_keep_their_type_and_names_may_clash(spark):
    rows = [(f"doc-{k}", "a b c d", "s", 1, 2, 3) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string, __s int, __k int, z int")
    out = m.mix(docs)
    assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes) and 14 <= out.count() <= 18


def test_small_tables_lose_no_source(spark):
    rows = [(k, "w " * 300, f"s{k % 20}") for k in range(200)]
    got = m.select_blocks(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.select("source").distinct().count() == 20


def test_weights_are_met(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, "w " * rng.randint(1, 40), f"s{min(k % 10, 3)}") for k in range(6000)], "doc_id long, text string, source string")
    got = {r[0]: r[1] for r in m.select_blocks(docs, weights={"s0": 2, "s1": 1, "s2": 1}, block_tokens=100, budget=0.2).groupBy("source").sum("n_tokens").collect()}
    total = sum(got.values())
    assert set(got) == {"s0", "s1", "s2"} and abs(got["s0"] / total - 0.5) < 0.02 and abs(got["s1"] / total - 0.25) < 0.02
