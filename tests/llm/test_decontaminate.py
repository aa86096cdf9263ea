import random
import time
import tracemalloc

import numpy as np

from tidemark.llm import decontaminate as d
from tidemark.llm.common import words


def brute_tiles(a, b, m):
    """Greedy tiling by looking at every pair of places in every round."""
    ua, ub, out = [True] * len(a), [True] * len(b), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and ua[i + n] and ub[j + n]:
                    n += 1
                if n >= m and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for k in range(best[2]):
            ua[best[0] + k] = ub[best[1] + k] = False


def test_tiling_equals_brute_force():
    rng = random.Random(0)
    for trial in range(150):
        m = rng.choice([2, 3, 4])
        item = [rng.choice("abcde" if trial % 2 else "abcdefghijklmnop") for _ in range(rng.randint(1, 25))]
        doc = [rng.choice("abcdefgh") for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            i, n = rng.randrange(len(item)), rng.randint(2, 9)
            k = rng.randint(0, len(doc))
            doc[k:k] = item[i : i + n]
        want = sum(n for _, _, n in brute_tiles(item, doc, min(m, len(item)))) / len(item)
        got = d.Index([(1, " ".join(item))], m).covered(" ".join(doc), 1e-9)
        assert (got[0][1] if got else 0) == want


def test_tiles_by_length_equal_brute_force():
    rng = random.Random(2)
    for trial in range(200):
        m = rng.choice([1, 2, 3])
        item = [rng.choice([1, 2] if trial % 2 else [1, 2, 3, 4]) for _ in range(rng.randint(m, 25))]
        doc = [rng.choice([0, 1, 2] if trial % 3 else [1, 2]) for _ in range(rng.randint(0, 40))]
        want = brute_tiles(item, [x or -1 for x in doc], m)
        assert d.long_tiles(np.array(item), np.array(doc, np.int64), m) == want
        index = d.Index([(1, " ".join(map(str, item)))], m)
        share = sum(n for _, _, n in want) / len(item)
        for limit in (0, d.SEEDS):
            d.SEEDS, before = limit, d.SEEDS
            got = index.covered(" ".join(map(str, doc)), 1e-9)
            d.SEEDS = before
            assert (got[0][1] if got else 0) == share


def test_texts_that_repeat_themselves_take_little_time_and_memory():
    for item in ("na " * 2000, "la le " * 1000, "a b c a b d " * 300):
        index = d.Index([(1, item)], 3)
        tracemalloc.start()
        began = time.process_time()
        assert index.covered(item * 10, 0.5) == [(0, 1.0)]
        assert time.process_time() - began < 3 and tracemalloc.get_traced_memory()[1] < 1e8
        tracemalloc.stop()


def test_ids_keep_their_type_and_names_may_clash(spark):
    bench = spark.createDataFrame([("q1", "a b c d")], "item_id string, text string")
    docs = spark.createDataFrame([("x", "a b c d", 1, 2), ("y", "e", 1, 2)], "doc_id string, text string, t int, item_id int")
    got = [(r.doc_id, r.item_id) for r in d.contamination(docs, bench).orderBy("doc_id").collect()]
    assert got == [("x", "q1"), ("y", None)] and d.drop_contaminated(docs, bench).columns == docs.columns


def test_reordered_passages(spark):
    rng = random.Random(1)
    item = [f"w{rng.randrange(60)}" for _ in range(40)]
    parts = [item[30:], item[10:20], item[20:30], item[:10]]
    doc = " ".join(f"x{k}" for k in range(300)) + " " + " filler between ".join(" ".join(p).upper() for p in parts) + " end."
    other = " ".join(rng.choice(item) for _ in range(400))
    docs = spark.createDataFrame([(1, doc), (2, other), (3, " ".join(item[:19]))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(item)), (8, "two words"), (9, ""), (10, None), (None, "lone wolf howls")], "item_id long, text string")
    got = {r.doc_id: (r.contaminated, r.coverage, r.item_id) for r in d.contamination(docs, bench).collect()}
    assert got[1] == (True, 1.0, 7) and not got[2][0] and not got[3][0]
    parts = {r.doc_id: (r.contaminated, r.coverage, r.item_id) for r in d.contamination(docs, bench, index_words=3).collect()}
    assert parts == got
    assert [r.doc_id for r in d.drop_contaminated(docs, bench).collect()] == [2, 3]


def test_ties_take_the_least_item(spark):
    bench = spark.createDataFrame([(5, "a b c d"), (4, "a b c d"), (6, "a b c d")], "item_id long, text string")
    (r,) = d.contamination(spark.createDataFrame([(1, "a b c d")], "doc_id long, text string"), bench).collect()
    assert (r.item_id, r.n_items) == (4, 3)


def test_awkward(spark, awkward, nothing):
    bench = spark.createDataFrame([(1, "a plain text of some"), (2, "no id here at")], "item_id long, text string")
    rows = d.contamination(awkward, bench).collect()
    assert len(rows) == awkward.count() and sorted(str(r.doc_id) for r in rows if r.contaminated) == ["1", "1", "8", "None"]
    kept = d.drop_contaminated(awkward, bench)
    assert kept.columns == awkward.columns and kept.count() == awkward.count() - 4
    assert d.contamination(nothing, bench).count() == 0
    assert d.contamination(awkward, bench.limit(0)).filter("contaminated").count() == 0
    assert words(None) == [] and words("ÀB c") == ["àb", "c"]
