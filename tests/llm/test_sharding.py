import itertools
from collections import Counter

import numpy as np

from tidemark.llm import sharding as s


def test_matrix_has_its_margins():
    rng = np.random.default_rng(0)
    for _ in range(20):
        sizes = rng.integers(0, 50, rng.integers(1, 12))
        shards = s.shard_sizes(int(sizes.sum()), 17)
        m = np.array([s.matrix_row(sizes, shards, i) for i in range(len(sizes))])
        assert (m.sum(axis=1) == sizes).all() and (m.sum(axis=0) == shards).all() and (m >= 0).all()
    assert s.shard_sizes(0).tolist() == [] and s.shard_sizes(10, 4).tolist() == [3, 3, 4]


def test_matrix_is_hypergeometric():
    sizes, shards = np.array([30, 50, 20]), np.array([40, 60])
    draws = np.array([s.matrix_row(sizes, shards, 1, seed)[0] for seed in range(4000)])
    mean, var = 50 * 0.4, 50 * 0.4 * 0.6 * 50 / 99
    assert abs(draws.mean() - mean) < 0.15 and abs(draws.var() / var - 1) < 0.1


def test_draws_beyond_the_limit(monkeypatch):
    rng = np.random.default_rng(1)
    exact = np.random.default_rng(2).hypergeometric(300, 700, 200, 20000)
    monkeypatch.setattr(s, "EXACT_COLORS", 10)
    ours = np.array([s._draw(rng, 300, 700, 200) for _ in range(20000)])
    assert abs(ours.mean() - exact.mean()) < 0.15 and abs(ours.var() / exact.var() - 1) < 0.05
    out = s.split(rng, np.array([4 * 10**9, 6 * 10**9, 5]), 5 * 10**9)
    assert out.sum() == 5 * 10**9 and abs(out[0] - 2 * 10**9) < 10**6 and out[2] <= 5
    assert s._draw(rng, 0, 50, 20) == 0 and s._draw(rng, 50, 0, 20) == 20 and s._draw(rng, 5, 5, 10) == 5


def test_matrix_equals_permuting_all_rows():
    """All matrices with these margins, as often as permutations of all rows give them."""
    sizes, ranges = [2, 1, 3], [3, 1, 2]
    owner = np.repeat(np.arange(3), sizes)
    want = Counter()
    for order in itertools.permutations(range(6)):
        to = np.empty(6, int)
        to[list(order)] = np.repeat(np.arange(3), ranges)
        want[tuple(np.bincount(owner * 3 + to, minlength=9).tolist())] += 1
    n, all_ = 6000, sum(want.values())
    draws = ([s.matrix_row(np.array(sizes), np.array(ranges), i, seed) for i in range(3)] for seed in range(n))
    got = Counter(tuple(np.concatenate(m).tolist()) for m in draws)
    assert got.keys() <= want.keys()
    chi = sum((got[m] - n * c / all_) ** 2 / (n * c / all_) for m, c in want.items())
    assert chi < len(want) + 4 * (2 * len(want)) ** 0.5


def test_places_are_uniform(spark, tmp_path):
    spark.range(12).repartition(3, "id").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for range_shards in (1, 3):
        places = Counter()
        for seed in range(30):
            for r in s.shuffle_into_shards(rows, rows_per_shard=4, seed=seed, range_shards=range_shards).collect():
                places[r.id, r.shard] += 1
        expected = 30 / 3
        assert sum((places[i, j] - expected) ** 2 / expected for i in range(12) for j in range(3)) < 60  # 24 degrees of freedom


def test_ranges_of_several_shards(spark):
    """More shards than partitions after the exchange: sizes stay exact."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n in (1, 50, 101):
            out = s.shuffle_into_shards(spark.range(n), rows_per_shard=4, range_shards=5)
            sizes = s.shard_sizes(n, 4).tolist()
            assert sorted((r.shard, r.position) for r in out.collect()) == [(j, p) for j, m in enumerate(sizes) for p in range(m)]
            assert sorted(r.id for r in out.collect()) == list(range(n))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_awkward(spark, awkward, nothing):
    out = s.shuffle_into_shards(awkward, rows_per_shard=5, shard_col="shard")
    assert out.columns == [*awkward.columns, "_shard", "position"]
    sizes = Counter(r._shard for r in out.collect())
    assert sorted(sizes.values()) == [4, 4, 4]
    assert Counter(map(str, out.select(*(f"`{c}`" for c in awkward.columns)).collect())) == Counter(map(str, awkward.collect()))
    assert sorted((r._shard, r.position) for r in out.collect()) == [(j, p) for j in range(3) for p in range(4)]
    assert s.shuffle_into_shards(nothing).count() == 0
