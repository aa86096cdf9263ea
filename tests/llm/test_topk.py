import numpy as np
import pytest

from tidemark.llm import topk as t

from ..conftest import SF


def brute(rows, k):
    out = set()
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    for i, v in fine:
        hits = []
        for j, w in fine:
            if j != i and len(w) == len(v):
                a, b = np.linalg.norm(v), np.linalg.norm(w)
                score = float(np.dot(v, w) / (a * b)) if a and b else 0.0
                hits.append((-round(score, 9), j, score))
        out |= {(i, r + 1, j, f"{s + 0.0:.7f}") for r, (_, j, s) in enumerate(sorted(hits)[:k])}
    return out


@pytest.mark.parametrize("part_rows", [10_000, 50])
def test_equals_brute_force(spark, part_rows):
    rng = np.random.default_rng(0)
    rows = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(30)]  # ties
    rows += [(300, [0.0] * 6), (301, [1.0, 2.0]), (302, [2.0, 1.0]), (303, []), (304, None), (None, [1.0] * 6), (305, [float("nan")] + [0.0] * 5), (306, [None] + [1.0] * 5), (307, [float("inf")] * 6), (1, rows[1][1])]
    v = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "vec_id long, embedding array<double>, score double, rank string")
    got = t.top_k(v, k=5, part_rows=part_rows).collect()
    want = brute(rows, 5)
    assert {(r.vec_id, r.rank, r.neighbor_id) for r in got} == {x[:3] for x in want} and len(got) == len(want)
    scores = {x[:3]: float(x[3]) for x in want}
    assert all(abs(r.score - scores[r.vec_id, r.rank, r.neighbor_id]) < 1e-5 for r in got)


@pytest.mark.parametrize("part_rows", [10_000, 40])
def test_several_vectors_of_one_id(spark, part_rows):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    near = np.array(rows[0][1])
    rows += [(i, (near + rng.normal(size=6) * 0.01).tolist()) for i, m in ((500, 2), (501, 5), (502, 14)) for _ in range(m)]
    got = t.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=5, part_rows=part_rows).collect()
    u = t.unit(np.array([v for _, v in rows]))
    ids = np.array([i for i, _ in rows])
    want = []
    for r, own in enumerate(ids):
        others = np.flatnonzero(ids != own)
        best = sorted(zip(-np.round(u[others] @ u[r], 9), ids[others]))[:5]
        want += [(int(own), k + 1, int(j)) for k, (_, j) in enumerate(best)]
    found = [(r.vec_id, r.rank, r.neighbor_id) for r in got]
    assert sorted(found) == sorted(want)


def test_few_and_none(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.neighbor_id) for r in t.top_k(v).orderBy("vec_id").collect()] == [(1, 2), (2, 1)]
    assert t.top_k(v.limit(0)).count() == 0


def exact(x, q, k, ids=None, own=None):
    ids = np.arange(len(x)) if ids is None else ids
    others = np.flatnonzero(ids != own) if own is not None else np.arange(len(x))
    return [int(j) for _, j in sorted(zip(-np.round(x[others] @ q, 9), ids[others]))[:k]]


@pytest.mark.parametrize("d, share, most", [(1000, 0.004, 0.05), (64, 0.03, 0.3)])
def test_each_query_stops_by_itself(d, share, most):
    """Sparse codes, of which each uses few dimensions: queries of a production batch read little."""
    rng = np.random.default_rng(1)
    x = t.unit(rng.normal(size=(20_000, d)) * (rng.random((20_000, d)) < share))
    x = x[np.abs(x).sum(axis=1) > 0]
    q = x[: t.BATCH]
    best, scored = t.Index(np.arange(len(x)), x).search(np.arange(len(q)), q, t.K)
    assert scored < most * len(q) * len(x)
    for k in range(0, len(q), 16):
        assert best[k][1].tolist() == exact(x, q[k], t.K, own=k)
    alone = sum(t.Index(np.arange(len(x)), x).search(np.array([k]), q[[k]], t.K)[1] for k in range(4))
    assert alone == t.Index(np.arange(len(x)), x).search(np.arange(4), q[:4], t.K)[1]  # a batch reads no more


def test_without_structure_all_is_scored(spark):
    """Vectors that point anywhere leave the bound above the k-th score to the end."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = t.unit(np.stack(rows["embedding"]).astype(float))
    best, scored = t.Index(rows["vec_id"].to_numpy(), x).search(rows["vec_id"].to_numpy()[:64], x[:64], t.K)
    assert scored >= 64 * len(x)
    assert best[5][1].tolist() == exact(x, x[5], t.K, rows["vec_id"].to_numpy(), rows["vec_id"][5])


@pytest.mark.parametrize("m", [2, 5, 14])
def test_own_id_leaves_the_bar_alone(m):
    """All vectors near the query are met in the first step, m of them under its own id."""
    rng = np.random.default_rng(3)
    near = [9, 0.1, 0.1, 0.1] + rng.normal(size=(m + 12, 4)) * np.r_[[0.05] * m, [0.5] * 12][:, None]
    x = t.unit(np.concatenate([rng.normal(size=(12_000, 4)) * [0.2, 1, 1, 1], near]))
    ids = np.arange(len(x))
    ids[-m - 12 : -12] = 20_000
    q = x[ids == 20_000]
    best, _ = t.Index(ids, x).search(np.full(m, 20_000), q, 10)
    for k in range(m):
        assert best[k][1].tolist() == exact(x, q[k], 10, ids, 20_000)


def test_ids_keep_their_type_and_names_may_clash(spark):
    rows = [("b", [1.0, 0.0], 1, 2), ("a", [1.0, 0.0], 1, 2), ("c", [0.0, 1.0], 1, 2)]
    v = spark.createDataFrame(rows, "vec_id string, embedding array<double>, id int, v int")
    got = [(r.vec_id, r.rank, r.neighbor_id, r.score) for r in t.top_k(v, k=1).orderBy("vec_id").collect()]
    assert got == [("a", 1, "b", 1.0), ("b", 1, "a", 1.0), ("c", 1, "a", 0.0)]
