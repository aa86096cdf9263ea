import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import tokens as k


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, (1 << 17) - 1), max_size=1500), st.sampled_from([(10, 7), (8, 9), (17,), (1, 16), (5, 5, 7)]))
def test_codes_round_trip(ids, widths):
    code = k.Code(k.encode(np.array(ids, np.uint32), widths))
    assert len(code) == len(ids) and code.all().tolist() == ids
    for i in range(0, len(ids), 13):
        assert code[i] == ids[i]
    with pytest.raises(IndexError):
        code[len(ids)]


def test_ids_must_fit():
    with pytest.raises(ValueError):
        k.encode(np.array([1 << 17]), (10, 7))
    with pytest.raises(ValueError):
        k.Code(b"nope")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'stredlmv.,!_-09aZéßñ²½日\xa0 \x1c"), st.characters(codec="utf-8")), max_size=80))
def test_split_equals_tokenizer(text):
    e = encoder()
    assert e.ids(text).tolist() == e.encoding.encode_ordinary(text)


_one = []


def encoder():
    if not _one:
        _one.append(k.Encoder())
    return _one[0]


def test_plain_texts_and_eviction(monkeypatch):
    e, rng = encoder(), random.Random(0)
    for _ in range(300):
        text = "".join(rng.choice(["the", " of", "'s", "'ll ", "  ", "\n\n ", "42", "_", " ?!", "é", "Àb", " ", "don't", "\t"]) for _ in range(rng.randint(0, 40)))
        assert k.PLAIN.fullmatch(text) and e.ids(text).tolist() == e.encoding.encode_ordinary(text)
    monkeypatch.setattr(k, "CACHE_WORDS", 3)
    assert e.ids("one two three four five").tolist() == e.encoding.encode_ordinary("one two three four five")


def test_awkward(spark, awkward, nothing):
    rows = k.token_codes(awkward).collect()
    texts = {(r.doc_id, r.text) for r in awkward.collect()}
    e = encoder()
    assert len(rows) == awkward.count()
    decoded = {(r.doc_id, None if r.code is None else e.encoding.decode(k.Code(r.code).all().tolist())) for r in rows}
    assert decoded == texts
    assert all((r.n_tokens is None) == (r.code is None) and (r.code is None or len(k.Code(r.code)) == r.n_tokens) for r in rows)
    assert k.token_codes(nothing).count() == 0
