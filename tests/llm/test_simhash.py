import random

import numpy as np

from tidemark.llm import simhash as s


def near(f, radius, confirm):
    d = np.bitwise_count(f[:, None, 0] ^ f[None, :, 0])
    e = np.bitwise_count(f[:, None, 1] ^ f[None, :, 1]) + np.bitwise_count(f[:, None, 2] ^ f[None, :, 2])
    return (d <= radius) & (e <= confirm)


def groups(hit):
    label = np.arange(len(hit))
    while True:
        new = np.array([label[row].min() for row in hit])
        if (new == label).all():
            return label
        label = new


def cluster(rng, n, flips, centre=None):
    base = rng.integers(0, 1 << 63, 3, dtype=np.uint64) if centre is None else centre
    out = np.tile(base, (n, 1))
    for row in out:
        for w in range(3):
            for b in rng.permutation(64)[: rng.integers(0, flips)]:
                row[w] ^= np.uint64(1) << np.uint64(b)
    return out


def test_fingerprint_bits_are_weighted_majorities():
    texts = ["one two three two", "", "x", "Ünï cödé — words words", "a " * 700]
    f = s.fingerprints(texts)
    for k, text in enumerate(texts):
        w = s.words(text)
        if not w:
            continue
        h = {(s.xxhash.xxh3_64_intdigest(x) & ~7 | min(max(len(x) - 2, 1), 7)) or 1 for x in w}
        bits = s.mix(np.array(sorted(h), np.uint64))
        weight = np.array([x & 7 for x in sorted(h)])
        ones = [(weight * ((bits >> np.uint64(b)) & np.uint64(1)).astype(int)).sum() for b in range(64)]
        assert f[k, 0] == sum(1 << b for b in range(64) if 2 * ones[b] > weight.sum())


def test_gray_rank_orders_the_gray_sequence():
    i = np.arange(5000, dtype=np.uint64)
    assert (s.gray_rank(i ^ (i >> np.uint64(1))) == i).all()


def whole(f, radius, confirm):
    """Components over the edges that all starts find."""
    label = np.arange(len(f))
    for start, width in enumerate(s.segments(radius)):
        group = s.rotated(f[:, 0], start, s.segments(radius)) >> np.uint64(64 - width)
        u, v = s._edges(np.arange(len(f)), f, group, np.full(len(f), start), radius, confirm)
        label = s.merge(label, u, v)
    return label


def test_no_pair_within_the_radius_is_missed():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, (3000, 3), dtype=np.uint64)
    other = base.copy()
    for k, row in enumerate(other):  # exactly at the radius or one beyond
        for b in rng.permutation(64)[: s.RADIUS + k % 2]:
            row[0] ^= np.uint64(1) << np.uint64(b)
    label = whole(np.concatenate([base, other]), s.RADIUS, s.CONFIRM_RADIUS)
    assert (label[3000:] == np.arange(3000)).tolist() == [k % 2 == 0 for k in range(3000)]


def test_components_are_exact():
    rng = np.random.default_rng(2)
    parts = []
    for n in (1, 2, 40, 64, 65, 700, 3):
        parts += [cluster(rng, n, 6), cluster(rng, n, 14), rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)]
    f = np.unique(rng.permutation(np.concatenate(parts)), axis=0)
    for radius, confirm in ((s.RADIUS, s.CONFIRM_RADIUS), (3, 20), (0, 0), (25, 40)):
        assert (whole(f, radius, confirm) == groups(near(f, radius, confirm))).all()


def test_the_tree_prunes_groups():
    """In one group of random entries at the production radius, few pairs are ever compared."""
    rng = np.random.default_rng(3)
    share, pairs = {}, {}
    for n in (20_000, 100_000):
        f = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
        f[:, 0] = f[:, 0] * np.uint64(2) >> np.uint64(5)
        f = f[np.argsort(s.gray_rank(f[:, 0]))]
        tree = s.GrayTree(f, np.zeros(n, int), 0, s.RADIUS, s.CONFIRM_RADIUS)
        tree.components()
        pairs[n], share[n] = tree.scanned, tree.scanned / (n * (n - 1) / 2)
    assert share[20_000] < 0.05 and share[100_000] < 0.02


def test_a_large_cluster_does_not_cost_all_its_pairs():
    rng = np.random.default_rng(4)
    f = np.unique(cluster(rng, 20_000, 5), axis=0)
    f = f[np.argsort(s.gray_rank(f[:, 0]))]
    tree = s.GrayTree(f, np.zeros(len(f), int), 0, s.RADIUS, s.CONFIRM_RADIUS)
    assert not tree.components().any() and tree.scanned < 0.1 * len(f) ** 2 / 2


def test_groups_are_cut_without_a_change(spark):
    rng = np.random.default_rng(5)
    f = np.unique(np.concatenate([cluster(rng, 8, 9) for _ in range(150)]), axis=0)
    rows = [(int(k), *map(int, row)) for k, row in enumerate(f.view(np.int64))]
    entries = spark.createDataFrame(rows, "id long, f0 long, f1 long, f2 long")
    want = groups(near(f, s.RADIUS, s.CONFIRM_RADIUS))
    for group_rows in (s.GROUP_ROWS, 200, 10):
        edges = s.match_edges(entries, group_rows=group_rows)
        got = {r.id: r.root for r in s.components(edges).collect()}
        assert [got.get(k, k) for k in range(len(f))] == want.tolist()


def texts(n, rng):
    out = []
    for _ in range(n):
        base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(30, 300))]
        out.append(" ".join(base))
        for _ in range(rng.randint(0, 2)):
            out.append(" ".join(w if rng.random() > 0.03 else w + "x" for w in base))
    return out


def jaccard(a, b):
    a, b = (set(zip(x, x[1:])) for x in (s.words(a), s.words(b)))
    return len(a & b) / max(len(a | b), 1)


def test_recall_against_brute_force(spark):
    rng = random.Random(3)
    t = texts(250, rng)
    f = s.fingerprints(t)
    hit = near(f, s.RADIUS, s.CONFIRM_RADIUS)
    pairs = {(i, j) for i, j in zip(*np.nonzero(hit)) if i < j}
    docs = spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    got = s.near_duplicate_groups(docs).collect()
    found = {(a, b) for r in got for k, a in enumerate(r.doc_ids) for b in r.doc_ids[k + 1 :]}
    assert pairs <= found and len(pairs) > 100
    like = {(i, j) for i in range(len(t)) for j in range(i + 1, len(t)) if jaccard(t[i], t[j]) >= 0.8}
    assert len(like & found) >= 0.95 * len(like) and len(like) > 100
    label = groups(hit)
    assert all(label[a] == label[b] for a, b in found)  # nothing beyond what brute force connects


def test_hot_group_and_chain(spark):
    base = " ".join(f"word{k}" for k in range(80))
    rows = [(k, base + f" tail{k}") for k in range(500)] + [(1000 + k, base) for k in range(500)] + [(5000, "quite another text of no kin")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    (g,) = s.near_duplicate_groups(docs).collect()
    assert g.kept_id == 0 and g.n_docs == 1000 and g.doc_ids == sorted(g.doc_ids)
    assert sorted(r.doc_id for r in s.drop_near_duplicates(docs).collect()) == [0, 5000]
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "u long, v long")
    for local in (0, 1000):
        got = {(r.id, r.root) for r in s.components(edges, local).collect()}
        assert got == {(k, 0) for k in range(1, 61)} | {(101, 100)}


def test_awkward(spark, awkward, nothing):
    (g,) = s.near_duplicate_groups(awkward).collect()
    assert g.doc_ids == [1, 8]
    kept = s.drop_near_duplicates(awkward)
    assert kept.columns == awkward.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert ids == [-1, -1, 1, 2, 3, 4, 5, 6, 7, 9]
    assert sorted(r.doc_id or 0 for r in s.drop_near_duplicates(awkward, broadcast_ids=0).collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7, 9]
    assert s.near_duplicate_groups(nothing).count() == 0 and s.drop_near_duplicates(nothing).count() == 0


def test_ids_keep_their_type_and_names_may_clash(spark):
    base = " ".join(f"word{k}" for k in range(80))
    rows = [("doc-2", base, 1, 2, 3), ("doc-10", base, 4, 5, 6), ("doc-3", base + " more", 7, 8, 9), ("x", "other", 1, 1, 1), ("x", "another", 2, 2, 2)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, __again int, __gone int, again int")
    (g,) = s.near_duplicate_groups(docs).collect()
    assert (g.kept_id, g.doc_ids) == ("doc-10", ["doc-10", "doc-2", "doc-3"])
    kept = s.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r[1], r[2], r[3]) for r in kept.select("doc_id", "__again", "__gone", "again").collect()) == [("doc-10", 4, 5, 6), ("x", 1, 1, 1), ("x", 2, 2, 2)]
