import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tidemark.llm import toxicity as t


def brute(counts, word, cls):
    """log P of a word under one class, from the definition with dictionaries."""
    kinds = [defaultdict(set) for _ in range(t.ORDER)]
    for g in counts:
        for k in range(1, t.ORDER):
            kinds[k][g[t.ORDER - k :]].add(g[t.ORDER - k - 1 :])

    def shared(g):
        k = len(g)
        if k == 0:
            return 1 / (len(kinds[1]) + 1)
        followers = {h: len(v) for h, v in kinds[k].items() if h[:-1] == g[:-1]}
        total = sum(followers.values())
        return max(followers[g] - t.DISCOUNT, 0) / total + t.DISCOUNT * len(followers) / total * shared(g[1:])

    n = [c[cls] for c in counts.values()]
    one, two = n.count(1), n.count(2)
    d = one / (one + 2 * two) if one and two else t.DISCOUNT
    p = 0.0
    for g in t.grams(word):
        here = {h: c[cls] for h, c in counts.items() if h[:-1] == g[:-1]}
        total = sum(here.values())
        low = shared(g[1:]) if g in counts else None
        if low is None:
            p += math.log(d * sum(c > 0 for c in here.values()) / total) if total else 0.0
        elif not total:
            p += math.log(low)
        else:
            p += math.log(max(here.get(g, 0) - d, 0) / total + d * sum(c > 0 for c in here.values()) / total * low)
    return p


def test_model_equals_definition():
    rng = random.Random(0)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    counts = defaultdict(lambda: [0, 0])
    for w in words:
        n = (rng.randint(0, 3), rng.randint(0, 2))
        for g in t.grams(w):
            if sum(n):
                counts[g][0] += n[0]
                counts[g][1] += n[1]
    names = list(counts)
    model = t.Model(names, *(np.array([counts[g][k] for g in names]) for k in (0, 1)))
    probe = words[:25] + ["abcabc", "zz", "é"]
    want = [brute(counts, w, 1) - brute(counts, w, 0) for w in probe]
    assert np.allclose(model.evidence(probe), want, atol=1e-4)


def corpus(rng, n):
    common = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    rows = []
    for k in range(n):
        toxic = k % 5 == 0
        words = [rng.choice(common) for _ in range(rng.randint(20, 200))]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), "vex" + rng.choice(["ed", "ing", "orium", "als", "mo"]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(random.Random(1), 1500)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 1000], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in t.toxicity(docs, labels).collect()}
    held = [r for r in rows if r[0] >= 1000]
    assert sum(got[k] for k, _, y in held if y) >= 0.98 * sum(y for *_, y in held)
    assert sum(got[k] for k, _, y in held if not y) <= 0.01 * len(held)
    assert t.drop_toxic(docs, labels).count() == 1500 - sum(got.values())


def test_one_passage_of_a_long_text_counts():
    rng = random.Random(2)
    rows = corpus(rng, 1000)
    seen = (t.Counter(), t.Counter())
    for _, text, y in rows:
        seen[y].update(t.words(text))
    b = t._gram_rows(seen)
    m = t.Model(b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy())
    clean = " ".join(x for _, x, y in rows[:100] if not y)
    a, z = m.measures([t.words(clean), t.words(clean + " vexing")], {})
    assert all(z[k] > 2 * max(a[k], 0.5) for k in (0, 1)) and abs(a[-1] - z[-1]) < 0.1


def test_measures_are_means_over_windows():
    rng = random.Random(5)
    model = t.Model.__new__(t.Model)
    model.empty = False
    cache = {f"w{k}": rng.gauss(0, 1) for k in range(9)}
    for n in (0, 1, 2, 5, 40):
        ws = [f"w{rng.randrange(9)}" for _ in range(n)]
        e = [cache[w] for w in ws]
        want = [sum(e) / x if n <= x else max(sum(e[i : i + x]) / x for i in range(n - x + 1)) for x in t.WINDOWS]
        assert np.allclose(model.measures([ws], dict(cache))[0], [*want, sum(e) / max(n, t.WINDOWS[-1])])


def test_expressions_of_two_words_count(spark):
    """Neither word speaks for a class, only the pair does."""
    rng = random.Random(6)
    filler = [f"f{k}" for k in range(300)]
    rows = []
    for k in range(1200):
        ws, pair = [rng.choice(filler) for _ in range(40)], ["crimson", "walrus"]
        ws[10:10] = pair if k % 6 == 0 else pair[::-1]
        rows.append((k, " ".join(ws), int(k % 6 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 800], "doc_id long, toxic int")
    got = {r.doc_id: r.rejected for r in t.toxicity(docs, labels).collect()}
    assert all(got[k] == bool(y) for k, _, y in rows if k >= 800)


def test_more_kinds_than_the_bound_shorten_the_order(spark):
    rows = corpus(random.Random(7), 900)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] < 600], "doc_id long, toxic int")
    half = t.labelled(docs, labels)
    *_, whole = t._models(half, t.MODEL_ENTRIES)
    *_, short = t._models(half, len(whole.gram) - 1)
    assert (whole.order, short.order) == (5, 4)
    shared = t.train(docs, labels, model_entries=len(whole.gram) - 1)
    got = {r.doc_id: r.s > 1 for r in docs.select("doc_id", t.score(shared, docs.text).alias("s")).collect()}
    held = [r for r in rows if r[0] >= 600]
    assert sum(got[k] for k, _, y in held if y) >= 0.95 * sum(y for *_, y in held)
    assert sum(got[k] for k, _, y in held if not y) <= 0.02 * len(held)


def test_models_don_t_depend_on_the_number_of_kinds(spark, monkeypatch):
    """However many kinds are counted, the models are those of the definition, of the whole order."""
    rows = [*corpus(random.Random(8), 300), (300, "日本語のテキスト \U0001f600x naïve", 1)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    half = t.labelled(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"))
    got = t.gram_counts(half).toArrow().sort_by("g")
    names, n = np.array(got.column("g").to_pylist(), object), [got.column(f"n{k}").to_numpy() for k in range(4)]
    monkeypatch.setattr(type(half), "count", lambda self: 10**9)
    models = t._models(half, t.MODEL_ENTRIES)
    for model, (a, b) in zip(models, ((n[0], n[1]), (n[2], n[3]), (n[0] + n[2], n[1] + n[3])), strict=True):
        at = a + b > 0
        want = t.Model(names[at].tolist(), a[at], b[at])
        assert model.order == want.order == t.ORDER
        for k in ("gram", "gram_llr", "context", "context_llr"):
            assert np.array_equal(getattr(model, k), getattr(want, k)), k


def test_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    rows = t.toxicity(awkward, labels).collect()
    assert len(rows) == awkward.count() and all(r.toxic_score == 0 for r in rows if r.doc_id in (2, 3, 5, 6))
    kept = t.drop_toxic(awkward, labels)
    assert kept.columns == awkward.columns
    none = t.toxicity(awkward, labels.limit(0)).collect()
    assert {(r.toxic_score, r.rejected) for r in none} == {(0.0, False)}
    assert t.toxicity(nothing, labels).count() == 0


@pytest.mark.parametrize("sf, least", [("sf0.01", {"en": 0.8}), ("sf0.1", {"en": 0.85, "fr": 0.8, "de": 0.75, "es": 0.5})])
def test_held_out_recall_by_language(spark, sf, least):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{n}.parquet") for n in ("documents", "labels"))
    held = labels.filter("pmod(xxhash64(doc_id), 5) = 0")
    got = t.toxicity(docs, labels.join(held, "doc_id", "left_anti")).join(held, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    clean, toxic = got[got.toxic == 0], got[got.toxic == 1]
    assert clean.rejected.mean() <= 0.02
    recall = toxic.groupby("lang").rejected.mean()
    assert {k: recall[k] for k, v in least.items() if recall[k] < v} == {}, recall
    print(sf, dict(recall), clean.rejected.mean(), toxic.groupby("lang").size().to_dict())


def test_bar_lies_between_the_classes():
    assert t.set_bar([(0, 0, 90), (0, 10, 10), (1, 60, 5), (1, 0, 1)]) == 35 * t.BIN
    assert t.set_bar([(0, 0, 90), (0, 50, 10), (1, 0, 9)]) is None and t.set_bar([(0, 0, 9)]) is None


def test_words_beyond_the_bound_go_by_toxic_documents(spark):
    rows = spark.createDataFrame([("often", 1)] * 4 + [("seldom", 1)] * 2 + [("plain", 0)] * 5, "t string, y int")
    assert len(t.vocabulary(rows).key) == 2
    assert list(t.vocabulary(rows, 1).evidence(["often", "seldom", "plain"])) == ["often"]


def test_every_expression_is_kept_in_any_number_of_passes(spark, monkeypatch):
    texts = [(text, k % 2) for k, text, _ in corpus(random.Random(9), 120)]
    n = defaultdict(lambda: [0, 0])
    for text, y in texts:
        for w in t.Texts([t.words(text)]).expressions()[1].tolist():
            n[w][y] += 1
    want = {w: tuple(x) for w, x in n.items() if x[1] >= max(x[0], t.LEAST_DOCS)}
    cut = t._most_toxic
    monkeypatch.setattr(t, "_most_toxic", lambda held, room: cut(held, 1))  # as if there were more than any bound
    monkeypatch.setattr(t, "KEYS_AT_ONCE", sum(x[1] >= t.LEAST_DOCS for x in n.values()) // 3, raising=False)
    found = t.vocabulary(spark.createDataFrame(texts, "t string, y int"))
    assert len(want) > 100 and dict(zip(found.key.tolist(), zip(found.n0.tolist(), found.n1.tolist()))) == want
    assert found.keys.find(found.key).tolist() == list(range(len(want)))


def test_ids_keep_their_type_and_names_may_clash(spark):
    docs = spark.createDataFrame([(f"d{k}", "vile words" if k % 2 else "kind words", k, k) for k in range(40)], "doc_id string, text string, toxic_score int, y int")
    labels = spark.createDataFrame([(f"d{k}", k % 2) for k in range(30)], "doc_id string, toxic int")
    got = {r.doc_id: r.rejected for r in t.toxicity(docs, labels).collect()}
    assert got["d31"] and not got["d30"] and t.drop_toxic(docs, labels).columns == docs.columns
