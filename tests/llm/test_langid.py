import random

import numpy as np

from tidemark.llm import langid as g

SYLLABLES = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["strå", "enk", "gö", "ver"], "cc": ["qui", "ción", "ñe", "lla"]}


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        out.append((k, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 120))), lang))
    return out


def test_gradients():
    n = g.Network(["a", "b", "c"], hidden=3)
    x = np.random.default_rng(0).integers(0, 256, (4, 7))
    x[0, 4:] = g.PAD
    y = np.array([0, 1, 2, 0])
    _, grad = n.gradients(x, y, np.ones(4))
    for k, d in grad.items():
        for at in zip(*np.unravel_index(np.argsort(-np.abs(d).ravel())[:5], d.shape)):
            old = n.weights[k][at]
            two = []
            for e in (1e-5, -1e-5):
                n.weights[k][at] = old + e
                two.append(n.gradients(x, y, np.ones(4))[0])
            n.weights[k][at] = old
            assert abs((two[0] - two[1]) / 2e-5 - d[at]) < 1e-6


def test_batches_equal_one_document_at_a_time():
    n = g.Network(["a", "b"], hidden=4)
    docs = [b"", b"x", bytes(range(256)) * 3, b"abc" * 50, b"z" * g.SEGMENT]
    offsets = np.cumsum([0, *map(len, docs)])
    total, count = n.documents(np.frombuffer(b"".join(docs), np.uint8), offsets)
    half = lambda w, a: 1 / (1 + np.exp(-a))
    for d, doc in enumerate(docs):
        want = np.zeros(2)
        for s in range(0, len(doc), g.SEGMENT):
            part, h = doc[s : s + g.SEGMENT], []
            for side, order in ((0, part), (1, part[::-1])):
                state, states = np.zeros(4), []
                for b in order:
                    e, a = n.weights["E"][side, b], state @ n.weights["U"][side]
                    r, z = half(0, e[:4] + a[:4]), half(0, e[4:8] + a[4:8])
                    state = (1 - z) * np.tanh(e[8:] + r * a[8:]) + z * state
                    states.append(state)
                h.append(states if side == 0 else states[::-1])
            for a, b in zip(*h):
                p = np.exp(a @ n.weights["V"][0] + b @ n.weights["V"][1] + n.weights["c"])
                want += p / p.sum()
        assert np.allclose(total[d], want, atol=1e-3) and count[d].sum() == len(doc)


def test_held_out_accuracy(spark):
    rows = corpus(900, 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in g.identify(docs.filter("doc_id >= 300"), docs.filter("doc_id < 300"), steps=80).collect()}
    assert sum(got[k] == lang for k, _, lang in rows if k >= 300) >= 0.97 * len(got)


def test_awkward(spark, awkward, nothing):
    rows = g.identify(awkward, steps=2).collect()
    assert len(rows) == awkward.count() and all(r.lang is None and r.n_bytes == 0 for r in rows if r.doc_id in (2, 3))
    assert all(sum(r.position_counts) == r.n_bytes for r in rows)
    texts = {r.doc_id: r.text for r in awkward.collect()}
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) for r in rows if r.doc_id)
    assert g.identify(nothing).count() == 0
    none = g.identify(awkward, awkward.limit(0)).collect()
    assert len(none) == awkward.count() and all(r.lang is None and r.languages == [] for r in none)


def test_rare_languages_are_known(spark):
    rare = [(10_000 + k, " ".join("жшщ" * n for n in range(1, 9)), "rr") for k in range(4)]
    docs = spark.createDataFrame(corpus(4000, 2) + rare, "doc_id long, text string, lang string")
    got = g.identify(docs.filter("doc_id % 20 = 0"), docs, steps=80, sample=60).collect()
    assert got[0].languages == ["aa", "bb", "cc", "rr"]
    assert [r.lang for r in got if r.doc_id >= 10_000] == ["rr"]


def test_shares():
    assert g.shares({"a": 1, "b": 1000, "c": 1000, "d": 20}, 100) == {"a": 1, "d": 20, "b": 39, "c": 40}
    assert g.shares({"a": 5, "b": 5, "c": 5}, 2) == {"a": 1, "b": 1, "c": 1} and g.shares({}, 9) == {}


def test_ties_take_the_first_language():
    n = g.Network(["aa", "bb"], hidden=2)
    n.weights = {k: np.zeros_like(v) for k, v in n.weights.items()}
    total, count = n.documents(np.frombuffer(b"some text", np.uint8), np.array([0, 9]))
    assert total[0].argmax() == 0 and total[0][0] == total[0][1] and count[0].tolist() == [9, 0]


def test_ids_keep_their_type_and_long_texts_give_segments_from_everywhere(spark):
    docs = spark.createDataFrame([("x", "a" * 40, "aa"), ("y", "b" * 40, "bb")], "doc_id string, text string, lang string")
    assert [r.doc_id for r in g.identify(docs, steps=2, per_document=1).orderBy("doc_id").collect()] == ["x", "y"]
    x, _ = g.segments(["".join(chr(97 + k // g.LENGTH % 26) for k in range(26 * g.LENGTH))], most=26)
    assert sorted(chr(row[0]) for row in x) == [chr(97 + k) for k in range(26)]
