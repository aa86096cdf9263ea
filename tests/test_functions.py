import base64
import pickle
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark.errors import InvalidValue
from tidemark.functions import filters as f
from tidemark.functions import ids, text
from tidemark.functions.chunking import Chunker, Limits, Piece
from tidemark.functions.counting import PatternCounter, WordCounter, default_counter
from tidemark.functions.vectors import cosine
from tidemark.operators.mmr import mmr


def test_ids(spark):
    assert ids.parse_sequence("a_msg_b_msg_12") == 12 and ids.parse_sequence("s_evt_0") == 0
    for bad in ("x", "s_msg_", "s_msg_x"):
        with pytest.raises(InvalidValue):
            ids.parse_sequence(bad)
    rows = spark.createDataFrame([("a_b_msg_3",), ("s_evt_7",), ("nope",), (None,)], "id string")
    assert [r[0] for r in rows.select(ids.sequence_of(F.col("id"), strict=False)).collect()] == [3, 7, None, None]
    with pytest.raises(Exception, match="malformed"):
        rows.filter("id = 'nope'").select(ids.sequence_of(F.col("id"))).collect()


def test_filters(spark):
    rows = spark.createDataFrame([("user", "café v%k"), ("tool", "VECTOR"), (None, "vector_x")], "role string, t string")
    count = lambda c: rows.filter(c).count()
    assert count(f.contains(F.col("t"), "café")) == 1 and count(f.contains(F.col("t"), "%")) == 1 and count(f.contains(F.col("t"), "_")) == 1
    assert count(f.contains(F.col("t"), "vector")) == 1 and count(f.contains(F.col("t"), "vector", True)) == 2
    assert count(f.without_tools()) == 1  # a null role goes too
    assert f.roles(False, False) is None and f.of_user("") is None
    e = spark.createDataFrame([("content_block:start",), ("tool:pre",), ("toolbox",)], "event string")
    assert e.filter(f.category("content")).count() == 1 and e.filter(f.category("tool")).count() == 1


BLOCKS = '[{"type":"thinking","thinking":"hm"},{"type":"text","text":"a"},{"type":"tool_use","name":"ls"},{"type":"text","text":"b"},{"type":"tool_result","content":"out"}]'


def test_extraction(spark):
    rows = spark.createDataFrame([("user", "hi"), ("user", '"q\\n"'), ("user", '[{"type":"text","text":"x"}]'), ("assistant", BLOCKS), ("assistant", "plain"), ("assistant", "[]"), ("tool", "z" * 10_050), ("system", "s"), ("user", ""), ("user", None), (None, "n")], "role string, content string")
    got = [tuple(r) for r in text.extracted(rows).select("user_query", "assistant_response", "assistant_thinking", F.length("tool_output")).collect()]
    assert got == [("hi", None, None, None), ("q\n", None, None, None), ("x", None, None, None), (None, "a\n\nb", "hm", None), (None, "plain", None, None), (None, None, None, None), (None, None, None, 10_000), *[(None, None, None, None)] * 4]


def test_display(spark):
    rows = spark.createDataFrame([(BLOCKS,), ("plain",), (None,), ("[]",)], "c string")
    assert [r[0] for r in rows.select(text.display(F.col("c"))).collect()] == ["[thinking] hm\na\n[tool_use: ls]\nb\n[tool_result] out", "plain", "", "[]"]
    events = [("tool:pre", '{"data":{"tool_name":"ls"}}', "tool:pre | tool=ls"), ("llm:response", '{"data":{"model":"m","provider":"p","usage":{"input":1,"output":2}}}', "llm:response | model=m | provider=p | tokens=1in/2out"), ("content_block:end", '{"data":{"block_type":"text","block_index":0,"total_blocks":2}}', "content_block:end | type=text | block=0/2"), ("orchestrator:complete", '{"data":{"orchestrator":"o","turn_count":3}}', "orchestrator:complete | orchestrator=o | turns=3"), ("delegate:agent_completed", '{"data":{"agent_name":"x"}}', "delegate:agent_completed | agent=x"), ("other", None, "other")]
    rows = spark.createDataFrame([e[:2] for e in events], "event string, data string")
    assert [r[0] for r in rows.select(text.event_display(F.col("event"), F.col("data"))).collect()] == [e[2] for e in events]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in rows.select(cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, None, None]


def test_mmr():
    v = [(1, 0, 0), (1, 0, 0), (0.9, 0.1, 0), (0, 1, 0), (0, 0, 1)]
    for lam in (1, 0.7, 0.5):
        assert mmr(v, v[0], 3, lam) == [0, 1, 2]
    assert mmr(v, v[0], 3, 0) == [0, 3, 4]
    assert mmr([], (1, 0), 3) == [] and mmr(v, v[0], 0) == [] and mmr(v, v[0], 9) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        mmr(v, v[0], 2, 1.5)
    with pytest.raises(ValueError):
        mmr(v, (1, 0), 2)


S = "This is a sentence that has twelve simple words in it now."


def test_chunks_are_whole_when_short():
    c = Chunker(WordCounter(), Limits(100, 40, 10, 5))
    assert c.chunks("", "user_query") == [("", 0, 0, 0)] and c.chunks(None, "x") == [("", 0, 0, 0)]
    assert c.chunks("  \n", "x") == [("  \n", 0, 3, 0)] and c.chunks(S, "user_query") == [(S, 0, len(S), 12)]


def test_chunks_overlap_and_cover():
    t = " ".join(f"{S[:-1]} {k}." for k in range(60))
    out = Chunker(WordCounter(), Limits(100, 40, 15, 5)).chunks(t, "user_query")
    assert len(out) > 10 and out[0][1] == 0 and out[-1][2] == len(t)
    assert all(a[1] < b[1] <= a[2] for a, b in zip(out, out[1:]))  # spans overlap
    assert all(n <= 40 for *_, n in out[:-1])


def test_chunks_keep_fences_and_add_short_tails():
    code = "```py\n" + "\n\n".join("x = 1" for _ in range(8)) + "\n```"
    out = Chunker(WordCounter(), Limits(20, 30, 0, 5)).chunks(f"{S}\n\n{code}\n\n{S}\n\nEnd.", "assistant_response")
    assert any(code in c[0] for c in out) and out[-1][0].endswith("End.")
    lines = Chunker(WordCounter(), Limits(5, 6, 0, 0)).chunks("a b c\n\nd e f\ng h", "tool_output")
    assert [c[0] for c in lines] == ["a b c\n\nd e f", "g h"]


def test_force_split():
    out = Chunker(WordCounter(), Limits(5, 4, 0, 0)).chunks("a b c d e f g h i", "user_query")
    assert [c[0] for c in out] == ["a b c d", "e f g h", "i"] and out[1][1:3] == (8, 15)


def test_counters():
    assert PatternCounter().count("a, b!") == 4 and PatternCounter().truncate("a, b!", 2) == "a," and WordCounter().truncate(" a b c", 2) == " a b"


def test_forced_pieces_equal_adding_words_one_by_one():
    class Bytes:  # counts that don't add up
        additive = False

        def count(self, text):
            return -(-len(text) // 3)

    rng = random.Random(0)
    for counter in (WordCounter(), PatternCounter(), Bytes()):
        for _ in range(50):
            c = Chunker(counter, Limits(embed=1, target=rng.randint(1, 12), overlap=0, least=0))
            text = " ".join("".join(rng.choice("ab,") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 40)))
            want, held = [], []
            for word in text.split():
                if held and counter.count(" ".join([*held, word])) > c.limits.target:
                    want.append(" ".join(held))
                    held = []
                held.append(word)
            assert [x[0] for x in c._forced(Piece(text, 0, len(text), 99))] == [*want, " ".join(held)]
    began = time.process_time()
    Chunker(WordCounter()).chunks("word " * 100_000, "tool_output")
    assert time.process_time() - began < 2


def test_rank_file_counter(tmp_path):
    ranks = tmp_path / "ranks"
    pieces = [bytes([b]) for b in range(256)] + [b"he", b"ll", b"hell", b"hello"]
    ranks.write_bytes(b"\n".join(base64.b64encode(p) + b" " + str(k).encode() for k, p in enumerate(pieces)))
    c = default_counter(str(ranks))
    assert (c.count("hello"), c.count("hello hello"), c.truncate("hello hello", 1), c.truncate("hi", 9)) == (1, 3, "hello", "hi")
    assert isinstance(default_counter("/nowhere"), PatternCounter) and pickle.loads(pickle.dumps(c)).count("hell") == 1
