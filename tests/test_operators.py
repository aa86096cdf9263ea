import json
import logging
import os
import sys
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.engine import Engine
from tidemark.errors import InvalidSession, InvalidValue
from tidemark.functions.chunking import Chunker, Limits
from tidemark.functions.counting import WordCounter
from tidemark.functions.filters import SearchFilters
from tidemark.functions.vectors import cosine_to
from tidemark.logging_json import JsonFormatter
from tidemark.operators import context, embed, events, search, sessions, upsert, vectors
from tidemark.schemas import SESSIONS
from tidemark.sources import sessions_dir, star
from tidemark.sources.store import Store
from tidemark.streaming import ingest, windows

from .conftest import SF

ROWS = [(0, None, "system"), (1, 1, "user"), (2, 1, "assistant"), (3, 2, "user"), (4, 2, "tool"), (5, 2, "assistant"), (6, 3, "user"), (7, 3, "assistant"), (8, None, "tool"), (9, 4, "user")]


@pytest.fixture(scope="module")
def messages(spark):
    rows = [(f"s_msg_{n}", "u", "h", "p", "s", n, role, f"text {n}", turn, datetime(2024, 1, 15, 10, n)) for n, turn, role in ROWS]
    return spark.createDataFrame(rows, "id string, user_id string, host_id string, project_slug string, session_id string, sequence int, role string, content string, turn int, ts timestamp")


def test_message_context(messages):
    got = context.message_context(messages, "s", 5, before=2, after=2).collect()
    assert [(r.sequence, r.position) for r in got] == [(3, "previous"), (4, "previous"), (5, "current"), (6, "following"), (7, "following")]
    assert all(r.has_more_before and r.has_more_after for r in got)
    got = context.message_context(messages, "s", 4, before=1, after=1, include_tools=False).collect()
    assert [r.position for r in got] == ["previous", "following"]
    assert context.message_context(messages, "other", 5).count() == 0


def test_turn_context(messages):
    got = context.turn_context(messages, "s", 2, before=1, after=1).collect()
    assert [r.sequence for r in got] == [1, 2, 3, 4, 5, 6, 7] and not got[0].has_more_before and got[0].has_more_after
    assert tuple(context.context_totals(context.turn_context(messages, "s", 99), "turn").first()) == (0, 0, 0)


def test_gaps(spark, messages):
    rows = messages.filter("sequence NOT IN (2, 7)")
    expected = spark.createDataFrame([("s", 10), ("empty", 2), ("skip", None)], "session_id string, expected int")
    got = {r.session_id: r.missing for r in context.sync_gaps(rows, expected).collect()}
    assert got == {"s": [2, 7], "empty": [0, 1]}
    assert [r.sequence for r in context.missing_sequences(rows, expected.filter("session_id = 'empty'"), base=1).collect()] == [1, 2]


def test_fold(spark):
    log = spark.createDataFrame([("a", "s", 1, "old", "t0"), ("a", "s", 2, "new", "t1"), (None, "s", 1, "x", "t2"), (None, "s", 3, None, "t3")], "user_id string, session_id string, v int, bundle string, created string")
    got = {r.user_id: (r.bundle, r.created) for r in upsert.fold(log, upsert.SESSION_KEY, "v", ("created",)).collect()}
    assert got == {"a": ("new", "t0"), None: (None, "t2")}


def test_upsert_twice_is_once(messages):
    once = upsert.upsert_messages(messages, messages.withColumn("content", F.lit("new")), "sequence")
    twice = upsert.upsert_messages(once, messages.withColumn("content", F.lit("new")), "sequence")
    assert sorted(map(str, once.collect())) == sorted(map(str, twice.collect())) and once.filter("content = 'new'").count() == 10


def test_event_size(spark):
    rows = spark.createDataFrame([("é" * 10,), ("x" * 500_000,), (None,)], "data string")
    got = [(r.data_size_bytes, r.data_truncated, r.data and r.data[:2]) for r in upsert.event_rows(rows).collect()]
    assert got == [(20, False, "éé"), (500_000, True, "{}"), (None, None, None)]
    guarded = upsert.oversize_guard(spark.createDataFrame([("ab",), ("x" * 50,), (None,)], "content string"), 10).collect()
    assert [r.content_truncated for r in guarded] == [False, True, False]


def test_vector_flag(spark, messages):
    v = spark.createDataFrame([("s_msg_1", [1.0]), ("s_msg_2", [1.0]), ("s_msg_2", None)], "parent_id string, vector array<double>")
    assert [r.id for r in upsert.with_vector_flag(messages, v).filter("has_vectors").collect()] == ["s_msg_1"]
    assert upsert.unembedded(messages, v).count() == 9 and upsert.add_vector_flag(messages).filter("has_vectors").count() == 0


def _vectors(spark):
    rows = [("a0", "s_msg_1", "user_query", 0, "vector", [1.0, 0.0, 0.0]), ("a1", "s_msg_1", "user_query", 1, "both", [0.9, 0.1, 0.0]), ("b0", "s_msg_2", "assistant_response", 0, "search", [0.0, 1.0, 0.0]), ("c0", "s_msg_3", "user_query", 0, "zero", [0.0, 0.0, 0.0]), ("d0", "s_msg_4", "tool_output", 0, "none", None)]
    return spark.createDataFrame(rows, "id string, parent_id string, content_type string, chunk_index int, source_text string, vector array<double>").withColumns({"span_start": F.lit(0), "span_end": F.lit(1)})


def test_vector_search(spark):
    v = _vectors(spark)
    got = vectors.vector_search(v, [1, 0, 0], 10).collect()
    assert [(r.parent_id, r.id, round(r.score, 6)) for r in got] == [("s_msg_1", "a0", 1.0), ("s_msg_2", "b0", 0.0), ("s_msg_3", "c0", 0.0)]
    assert vectors.vector_search(v, [1, 0, 0], 10, ["assistant_response"]).count() == 1
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0])], "query_id int, query array<double>")
    assert [(r.query_id, r.parent_id) for r in vectors.vector_search_many(v, q, 1).orderBy("query_id").collect()] == [(1, "s_msg_1"), (2, "s_msg_2")]
    assert vectors.approximate_join(v, q, 1).count() >= 1


def test_search(spark, messages):
    v = _vectors(spark)
    o = lambda q, **k: search.TranscriptSearchOptions(q, **k)
    assert [r.sequence for r in search.full_text(messages, None, o("text"), 3).orderBy("position").collect()] == [9, 7, 6]
    both = search.full_text(messages, v, o("vector"), 5).collect()
    assert [(r.sequence, r.matched_text, r.source) for r in both] == [(1, "vector", "full_text_chunk")]
    assert search.full_text(messages, None, o("text", search_in_user=False, search_in_assistant=False), 20).count() == 10
    assert [r.sequence for r in search.semantic(messages, v, [1, 0, 0], o("q"), 2).collect()] == [1, 2]
    one = search.hybrid(messages, v, [1, 0, 0], o("text", mmr_lambda=1.0), 2).collect()
    assert len(one) == 2 and one[0].sequence == 1
    assert search.search_transcripts(messages, None, o("text"), None, 2).count() == 2
    with pytest.raises(InvalidValue):
        search.search_transcripts(messages, v, o("x", search_type="magic"))
    late = o("text", filters=SearchFilters(start_date="2024-01-15 10:05:00", project_slug="p"))
    assert search.full_text(messages, None, late, 20).count() == 4


def test_events(spark):
    rows = [("u", "s", 1, "tool:pre", '{"data":{"tool_name":"ls"}}', "info"), ("u", "s", 2, "tool:post", '{"data":{"tool_name":"cat"}}', "info"), ("u", "s", 3, "llm:request", '{"data":{"model":"m","provider":"p"}}', "debug"), ("u", "s", 4, None, "{}", None)]
    e = spark.createDataFrame(rows, "user_id string, session_id string, sequence int, event string, data string, lvl string").withColumns({"ts": F.timestamp_seconds("sequence"), "project_slug": F.lit("p")})
    n = lambda **k: [r.sequence for r in events.search_events(e, **k).collect()]
    assert n() == [4, 3, 2, 1] and n(event_category="tool") == [2, 1] and n(tool_name="ls") == [1] and n(model="m", provider="p") == [3]
    assert n(event_type="tool:pre", event_category="llm") == [1] and n(level="debug") == [3] and n(limit=1) == [4] and n(user_id="x") == []
    assert {r.event_type: r.category for r in events.event_types(e).collect()} == {"tool:pre": "tool", "tool:post": "tool", "llm:request": "llm", "?": "?"}


class Flaky:
    dimensions, model_name = 2, "flaky"

    def embed_batch(self, texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("no")
        if any("down" in t for t in texts):
            raise ConnectionError("no")
        return [[1.0, float(len(t))] for t in texts]


def test_embedding_isolation(spark):
    fast = embed.Retry(attempts=1, sleep=lambda s: None)
    assert embed.embed_isolated(["bad"] * 5 + ["a"], Flaky(), 1, retry=fast) == [None] * 5 + [[1.0, 1.0]]  # bad input isn't the provider's fault
    got = embed.embed_isolated(["a", None, "bad", " ", "ccc"], Flaky(), 1, retry=fast)
    assert got == [[1.0, 1.0], None, None, None, [1.0, 3.0]]
    assert embed.embed_isolated(["down"] * 4 + ["a"], Flaky(), 1, retry=fast, breaker=embed.Breaker(threshold=3)) == [None] * 5


def test_only_passing_errors_are_tried_again_and_counted():
    class Bad(Exception):
        status_code = 400

    for error, tries in ((Bad(), 1), (ValueError(), 1), (TimeoutError(), 6), (OSError(), 6)):
        calls, b = [], embed.Breaker(threshold=100)

        def call(error=error, calls=calls):
            calls.append(1)
            raise error

        with pytest.raises(type(error)):
            embed.Retry(sleep=lambda s: None).run(call, b)
        assert len(calls) == tries and b.failures == (tries if tries > 1 else 0)


def test_texts_are_cut_to_the_providers_limit(spark, messages):
    class Short(embed.HashProvider):
        def embed_batch(self, texts):
            assert all(len(t.split()) <= 2 for t in texts)
            return super().embed_batch(texts)

    long = messages.withColumn("content", F.lit("one two three four"))
    got = embed.message_vectors(long, Short(8), Chunker(WordCounter(), Limits(embed=2, target=9, overlap=0, least=0))).collect()
    assert got and all(r.vector is not None and r.source_text == "one two three four" for r in got)


def test_known_vectors_are_not_made_again(spark, messages):
    class Never(embed.HashProvider):
        def embed_batch(self, texts):
            raise AssertionError

    first = embed.message_vectors(messages, embed.HashProvider(8))
    known = embed.known_vectors(first, "hashed-words")
    again = embed.message_vectors(messages, Never(8), known=known)
    assert again.filter("vector IS NULL").count() == 0 and again.count() == first.count() > 0


def test_retry_breaker_cache():
    class Limited(Exception):
        status_code, headers = 429, {"Retry-After": "7"}

    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Limited
        return [1]

    assert embed.Retry(sleep=waits.append).run(call, embed.Breaker()) == [1] and waits == [7.0, 7.0]
    clock = [0.0]
    b = embed.Breaker(threshold=1, rest=10, clock=lambda: clock[0])
    b.failed()
    assert not b.closed
    clock[0] = 11
    assert b.closed
    c = embed.Cache(2)
    for t in "abc":
        c.put(t, "m", [t])
    assert c.get("a", "m") is None and c.get("c", "m") == ["c"] and c.stats()["size"] == 2


def test_statistics_and_discovery(spark):
    rows = [("u1", "s1", "p1", "f", 5), ("u1", "s2", "p1", "f", 3), ("u2", "s3", "p1", "c", 0), ("u2", "s4", "p2", "f", 1), ("", "s5", "p2", "c", None)]
    s = spark.createDataFrame(rows, "user_id string, session_id string, project_slug string, bundle string, turn_count int").withColumns({"created": F.lit("2024-01-15").cast("timestamp"), "updated": F.lit(None).cast("timestamp"), "metadata": F.lit('{"tags":["x"]}')})
    got = {(r.dimension, r.key): r.n for r in sessions.session_statistics(s).collect()}
    assert got == {("total", None): 5, ("project", "p1"): 3, ("project", "p2"): 2, ("bundle", "f"): 3, ("bundle", "c"): 2}
    assert [r[0] for r in sessions.list_users(s).collect()] == ["u1", "u2"]
    a, b = (sessions.list_sessions(s, limit=2, offset=k).collect() for k in (0, 2))
    assert [r.session_id for r in a + b] == ["s1", "s2", "s3", "s4"]
    assert sessions.search_sessions(s, filters=SearchFilters(max_turn_count=0)).count() == 1
    assert sessions.search_sessions(s, filters=SearchFilters(tags=("x", "y"))).count() == 5


def test_engine(spark, tmp_path):
    with Engine(spark, Config(base_path=str(tmp_path), buckets=2), provider=embed.HashProvider(8)) as e:
        e.upsert_session_metadata([{"user_id": "u", "session_id": "s", "project_slug": "p", "created": datetime(2024, 1, 1), "bundle": "a"}])
        e.upsert_session_metadata([{"user_id": "u", "session_id": "s", "project_slug": "p", "created": datetime(2025, 1, 1), "bundle": "b", "turn_count": 2}])
        s = e.get_session_metadata("u", "s").first()
        assert (s.bundle, s.turn_count, s.created.year) == ("b", 2, 2024)
        lines = spark.createDataFrame([("u", "h", "p", "s", r, f"content {k}", k, k) for k, r in enumerate(["user", "assistant", "user"])], "user_id string, host_id string, project_slug string, session_id string, role string, content string, turn int, k int")
        assert tuple(e.sync_transcript_lines(lines, "k").first()) == (3, 3, 0)
        assert vars(e.backfill_embeddings("u")) == {"found": 0, "stored": 0, "failed": 0, "errors": []}
        e.sync_transcript_lines(lines.withColumn("content", F.lit("changed")), "k", with_vectors=False)
        assert [(r.id, r.content) for r in e.get_transcript_lines("u", "p", "s").collect()] == [(f"s_msg_{k}", "changed") for k in range(3)]
        e.sync_event_lines(lines.select("user_id", "host_id", "project_slug", "session_id", "k", F.lit("tool:pre").alias("event"), F.lit('{"data":{"tool_name":"ls"}}').alias("data")), "k", 1)
        assert [r.id for r in e.get_stored_event_ids("u", "p", "s").orderBy("id").collect()] == [f"s_evt_{k}" for k in (1, 2, 3)]
        gaps = {r.source: r.missing for r in e.find_missing_sequences("u", "s", 4, 3).collect()}
        assert gaps == {"transcripts": [3], "events": []}
        assert {(r.dimension, r.key): r.n for r in e.get_session_statistics().collect()}[("tool", "ls")] == 3
        assert e.search_transcripts("u", search.TranscriptSearchOptions("changed"), 2).count() == 2
        assert e.get_session_sync_stats("u", "p", "s").filter("n = 3").count() == 2
        assert e.vector_search("u", e.provider.embed_batch(["content 1"])[0], top_k=1).first().parent_id == "s_msg_1"
        e.upsert_embeddings(spark.createDataFrame([("s_msg_0", "u", "s", "p", [1.0] * 8)], "parent_id string, user_id string, session_id string, project_slug string, vector array<double>"), "m")
        assert e.store.read("transcript_vectors").filter("parent_id = 's_msg_0'").count() == 1
        assert e.get_active_sessions().count() == 1 and e.search_events(tool_name="ls").count() == 3
        before = e.store.read("transcripts").collect()
        e.compact(vacuum=True)
        at = e.store.snapshot("transcripts")
        assert at.base is not None and not at.log and not os.listdir(tmp_path / "transcripts" / "log")
        assert sorted(map(str, e.store.read("transcripts").collect())) == sorted(map(str, before))
        assert "Exchange" not in e.search_sessions()._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in e.store.read("transcripts").filter("role = 'user'")._jdf.queryExecution().executedPlan().toString()
        plan = e.vector_search("u", [1.0] * 8)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "PushedFilters: [IsNotNull(user_id)" in plan
        assert e.get_transcript_lines("u", "p", "s").count() == 3
        e.sync_transcript_lines(lines.filter("k < 1").withColumn("content", F.lit("x" * 2_000_000)), "k", with_vectors=False)
        assert [r.content[:11] for r in e.get_transcript_lines("u", "p", "s").collect()] == ["[content of", "changed", "changed"]
        e.initialize()
        assert spark.sql("SELECT count(*) FROM vectors_with_context").first()[0] == 3
        assert not e.delete_session("u", "other", "s") and e.delete_session("u", "p", "s")
        assert e.get_session_metadata("u", "s").count() == 0 and e.get_transcript_lines("u", "p", "s").count() == 0
        e.upsert_session_metadata([{"user_id": "u", "session_id": "s", "bundle": "again"}])
        assert e.get_session_metadata("u", "s").first().bundle == "again" and e.get_transcript_lines("u", "p", "s").count() == 0
        with pytest.raises(InvalidSession):
            e.upsert_session_metadata([{"user_id": "u"}])


def test_the_last_of_a_batch_holds(spark, tmp_path):
    e = Engine(spark, Config(base_path=str(tmp_path), buckets=2))
    batch = [{"user_id": "u", "session_id": "s", "bundle": f"b{k}", "created": datetime(2024, 1, 1 + k)} for k in range(5)]
    e.upsert_session_metadata(batch)
    s = e.get_session_metadata("u", "s").first()
    assert (s.bundle, s.created.day) == ("b4", 1)
    rows = spark.createDataFrame([("u", "s", f"c{k}", k) for k in range(5)], "user_id string, session_id string, bundle string, k int")
    e.upsert_session_metadata(rows.orderBy(F.col("k").desc()), order="k")
    s = e.get_session_metadata("u", "s").first()
    assert (s.bundle, s.created.day, s.turn_count) == ("c4", 1, 0)
    with pytest.raises(InvalidSession):
        e.upsert_session_metadata(rows)


def test_store_beside_compaction(spark, tmp_path):
    store = Store(spark, str(tmp_path), 2)
    rows = lambda *k: spark.createDataFrame([("u", f"s{n}", v) for n, v in k], "user_id string, session_id string, bundle string")
    got = lambda: {r.session_id: r.bundle for r in store.read("sessions").collect()}
    for k in range(4):
        store.append("sessions", rows((k, f"a{k}"), (9, f"x{k}")))
    old = store.snapshot("sessions")
    first = store.compact("sessions")
    assert store.compact("sessions") is None and store.snapshot("sessions").base == first
    assert got() == {"s0": "a0", "s1": "a1", "s2": "a2", "s3": "a3", "s9": "x3"}
    files = lambda: sum(len(f) for _, _, f in os.walk(tmp_path / "sessions"))
    n = files()
    assert store.vacuum("sessions") == len(old.log) and files() < n
    store.append("sessions", rows((1, "new"), (5, "more")))
    store.delete(rows((2, None), (9, None)))
    assert got() == {"s0": "a0", "s1": "new", "s3": "a3", "s5": "more"}
    late = store._version()  # taken before the compaction, written after it
    store.append("sessions", rows((2, "back")))
    store.compact("sessions")
    full = rows((7, "late")).withColumns({"__v": F.lit(late).cast("long"), "__bucket": store.bucket(F.col("session_id"))})
    for f in SESSIONS.fields:
        full = full if f.name in full.columns else full.withColumn(f.name, F.lit(None).cast(f.dataType))
    store._write(full.select(*SESSIONS.names, "__v", "__bucket"), f"sessions/log/__write={late}")
    assert got() == {"s0": "a0", "s1": "new", "s2": "back", "s3": "a3", "s5": "more", "s7": "late"}
    assert store.migrate(spark.createDataFrame([("m", "u", "s", "p", [1.0], None, None, None)], "id string, user_id string, session_id string, project_slug string, user_query_vector array<double>, assistant_response_vector array<double>, assistant_thinking_vector array<double>, tool_output_vector array<double>"))
    assert store.read("transcript_vectors").count() == 1 and store.migrate(spark.createDataFrame([], "id string")) is None


def test_backfill_goes_on_after_a_batch_that_fails(spark, tmp_path, messages, monkeypatch):
    e = Engine(spark, Config(base_path=str(tmp_path), buckets=2), provider=embed.HashProvider(8))
    e.store.append("transcripts", messages)
    real, seen = e._embed, []

    def embed_(rows):
        if rows.filter("sequence = 0").count():
            raise OSError("lost")
        return real(rows)

    monkeypatch.setattr(e, "_embed", embed_)
    out = e.backfill_embeddings("u", batch_size=4, on_progress=lambda *n: seen.append(n))
    assert (out.found, out.failed) == (10, 4) and out.stored > 0 and out.errors == ["batch 1: lost"] and seen == [(4, 10), (8, 10), (10, 10)]


def test_settings():
    c = Config.from_env({"TIDEMARK_BASE_PATH": "/x", "TIDEMARK_BUCKETS": "3", "TIDEMARK_REUSE_VECTORS": "yes", "OTHER": "1"})
    assert (c.base_path, c.buckets, c.reuse_vectors, c.dimensions) == ("/x", 3, True, 64)


def test_json_log_lines():
    record = logging.LogRecord("n", logging.WARNING, "f.py", 7, "hello %s", ("you",), None)
    record.session, record.odd = "s", {1}
    line = json.loads(JsonFormatter().format(record))
    assert (line["level"], line["message"], line["line"], line["session"], line["odd"]) == ("WARNING", "hello you", 7, "s", "{1}")
    try:
        raise ValueError("x")
    except ValueError:
        record.exc_info = sys.exc_info()
    assert json.loads(JsonFormatter().format(record))["exception_type"] == "ValueError"


def test_cosine_to(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [-6.0, -8.0])], "id int, vector array<double>")
    got = {r.id: r.s for r in v.select("id", cosine_to(F.col("vector"), [3, 4]).alias("s")).collect()}
    assert got == {1: 1.0, 2: None, 3: None, 4: 0.0, 5: None, 6: -1.0}
    assert [r.id for r in vectors.nearest(v, [0, 0], 9).collect()] == [1, 4, 6]


def test_session_directories(spark, tmp_path):
    d = tmp_path / "a_session"
    os.makedirs(d)
    (d / "metadata.json").write_text(json.dumps({"created": "2024-01-15T10:00:00Z", "more": 1}, indent=1))
    (d / "transcript.jsonl").write_text('{"role":"user","content":"hi","ts":"2024-01-15T10:00:00Z"}\n\n{"role":"assistant","content":[{"type":"text","text":"yo"}],"metadata":{"timestamp":"2024-01-15T10:01:00Z"}}\n')
    (d / "events.jsonl").write_text('{"event":"tool:pre","ts":"2024-01-15T10:00:00Z","data":{"tool_name":"ls"}}\n')
    m = sessions_dir.read_metadata(spark, str(tmp_path)).first()
    assert (m.session_id, m.project_slug, m.turn_count, m.created.year) == ("a_session", "unknown", 0, 2024) and "more" in m.metadata
    t = sessions_dir.read_messages(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r.role for r in t] == ["user", "assistant"] and t[1].ts.minute == 1 and t[1].content.startswith("[")
    assert sessions_dir.read_events(spark, str(tmp_path)).first().event == "tool:pre"


def test_stream_equals_batch(spark, tmp_path):
    batch = windows.event_time(star.events(spark, SF))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = windows.window_counts(stream, delay="400 days").writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = windows.window_counts(batch)
    got = spark.table("counts")
    assert sorted((str(r.window_start), r.event, r.n) for r in got.collect()) == sorted((str(r.window_start), r.event, r.n) for r in want.collect())
    seen = []
    ingest.into(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")), lambda df, k: seen.append(df.count()), str(tmp_path / "c2")).awaitTermination()
    assert sum(seen) == batch.count()


def test_chunk_operator(spark):
    rows = spark.createDataFrame([(1, "user_query", "a b"), (2, "user_query", ""), (3, "tool_output", None)], "parent_id long, content_type string, source_text string")
    assert [(r.parent_id, r.source_text, r.total_chunks) for r in embed.chunked(rows, Chunker()).orderBy("parent_id").collect()] == [(1, "a b", 1), (2, "", 1), (3, "", 1)]
