"""The registered queries: each operator over the test tables, with its DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import filters as f
from ..functions import ids, text
from ..functions.chunking import Chunker, Limits
from ..functions.counting import WordCounter, with_tokens
from ..functions.filters import SearchFilters
from ..operators import context, embed, events, search, sessions, upsert, vectors
from ..operators.mmr import rerank
from ..sources import star
from ..streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SESSIONS_SQL = """sessions AS (SELECT o_orderkey AS session_id, o_custkey AS user_id, o_orderpriority AS project_slug, o_orderstatus AS bundle, o_orderdate AS created, coalesce(n, 0) AS turn_count, updated
  FROM orders LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, max(l_shipdate) AS updated FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
ACTIVITY_SQL = """activity AS (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS sequence, l_linenumber AS turn, l_shipdate AS ts, l_returnflag AS role FROM lineitem)"""
COSINE_SQL = "list_inner_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / (sqrt(list_inner_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * sqrt(list_inner_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))))"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql.strip()
        return run

    return register


# -- sessions -------------------------------------------------------------------------------------------------

BUSY = SearchFilters(project_slug="1-URGENT", start_date="1995-01-01", end_date="1996-12-31", min_turn_count=3)


@query("search_sessions", f"""WITH {SESSIONS_SQL} SELECT * FROM sessions WHERE project_slug = '1-URGENT' AND created >= TIMESTAMP '1995-01-01' AND created <= TIMESTAMP '1996-12-31' AND turn_count >= 3 ORDER BY created DESC, session_id LIMIT 100""")
def search_sessions(spark, d):
    return sessions.search_sessions(star.sessions(spark, d), "", BUSY)


@query("session_point_read", f"WITH {SESSIONS_SQL} SELECT * FROM sessions WHERE session_id = (SELECT max(o_orderkey) FROM orders)")
def session_point_read(spark, d):
    last = star.table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    return sessions.get_session(star.sessions(spark, d), "", last)


@query("list_sessions_page", "SELECT o_custkey AS user_id, o_orderkey AS session_id, o_orderpriority AS project_slug, o_orderstatus AS bundle, o_orderdate AS created FROM orders ORDER BY created DESC, session_id LIMIT 50 OFFSET 100")
def list_sessions_page(spark, d):
    return sessions.list_sessions(star.sessions(spark, d, counted=False), limit=50, offset=100, columns=("user_id", "session_id", "project_slug", "bundle", "created"))


@query("list_users", "SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_orderpriority = '2-HIGH' AND o_custkey IS NOT NULL")
def list_users(spark, d):
    return sessions.list_users(star.sessions(spark, d, counted=False), SearchFilters(project_slug="2-HIGH"))


@query("list_projects", "SELECT DISTINCT o_orderpriority AS project_slug FROM orders WHERE o_orderpriority <> ''")
def list_projects(spark, d):
    return sessions.list_projects(star.sessions(spark, d, counted=False))


@query("active_sessions", f"""WITH {SESSIONS_SQL} SELECT * FROM sessions WHERE turn_count >= 2 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = session_id AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate <= TIMESTAMP '1996-03-31') ORDER BY coalesce(updated, created) DESC, session_id LIMIT 200""")
def active_sessions(spark, d):
    return sessions.active_sessions(star.sessions(spark, d), star.activity(spark, d), start_date="1996-01-01", end_date="1996-03-31", min_turn_count=2, limit=200)


@query("session_stats", "SELECT 'total' AS dimension, NULL AS key, count(*) AS n FROM orders UNION ALL SELECT 'project', o_orderpriority, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'bundle', o_orderstatus, count(*) FROM orders GROUP BY 2")
def session_stats(spark, d):
    return sessions.session_statistics(star.sessions(spark, d, counted=False))


@query("sync_stats", "SELECT 'transcripts' AS source, count(*) AS n, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem UNION ALL SELECT 'events', count(*), min(ts), max(ts) FROM events")
def sync_stats(spark, d):
    return sessions.sync_stats(star.activity(spark, d), star.events(spark, d))


@query("turn_bounds", "SELECT l_orderkey AS session_id, min(l_linenumber) AS first_turn, max(l_linenumber) AS last_turn FROM lineitem GROUP BY 1")
def turn_bounds(spark, d):
    return sessions.bounds(star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("turn")), "turn")


@query("sequence_bounds", f"WITH {ACTIVITY_SQL} SELECT session_id, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM activity GROUP BY 1")
def sequence_bounds(spark, d):
    return sessions.bounds(star.numbered_activity(spark, d).withColumn("sequence", F.col("sequence").cast("long")), "sequence")


# -- scans, context and gaps ----------------------------------------------------------------------------------


@query("transcript_cursor", f"WITH {ACTIVITY_SQL} SELECT session_id, CAST(sequence AS INTEGER) AS sequence, turn, ts, role FROM activity WHERE sequence > 3")
def transcript_cursor(spark, d):
    return context.lines(star.numbered_activity(spark, d), after_sequence=3)


@query("event_cursor", "SELECT event_id AS sequence, user_id AS session_id, event_type AS event, ts FROM events WHERE event_id > 500")
def event_cursor(spark, d):
    return context.lines(star.events(spark, d), after_sequence=500).select("sequence", "session_id", "event", "ts")


@query("stored_message_ids", "SELECT CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) AS id FROM conversations")
def stored_message_ids(spark, d):
    return context.ids(star.messages(spark, d))


@query("parsed_sequences", "SELECT CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) AS id, CAST(turn AS INTEGER) AS sequence, 'u|p|' || CAST(conv_id AS VARCHAR) AS partition_key FROM conversations")
def parsed_sequences(spark, d):
    m = star.messages(spark, d)
    return m.select("id", ids.sequence_of(F.col("id")).alias("sequence"), ids.partition_key(F.col("user_id"), F.col("project_slug"), F.col("session_id")).alias("partition_key"))


@query("logical_turns", "SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS sequence, role, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn FROM conversations")
def logical_turns(spark, d):
    return context.logical_turns(star.messages(spark, d)).select("session_id", "sequence", "role", "turn")


def _context_sql(on: str, before: int, after: int, rows: str, hits: str) -> str:
    return f"""WITH {rows}, hits AS ({hits}), ends AS (SELECT session_id, min({on}) AS f, max({on}) AS l FROM rows GROUP BY 1),
found AS (SELECT r.session_id, r.sequence, r.turn, r.role, h.anchor, r.{on} AS place, f, l FROM rows r JOIN hits h ON r.session_id = h.session_id AND r.{on} BETWEEN h.anchor - {before} AND h.anchor + {after} JOIN ends e ON e.session_id = r.session_id)
SELECT session_id, sequence, turn, role, anchor, CASE WHEN place < anchor THEN 'previous' WHEN place = anchor THEN 'current' ELSE 'following' END AS position,
min(place) OVER (PARTITION BY session_id, anchor) > f AS has_more_before, max(place) OVER (PARTITION BY session_id, anchor) < l AS has_more_after FROM found"""


_TURNS = "rows AS (SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS sequence, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS turn, role, text FROM conversations)"
_CONTEXT = ("session_id", "sequence", "turn", "role", "anchor", "position", "has_more_before", "has_more_after")


@query("turn_context", _context_sql("turn", 2, 1, _TURNS, "SELECT DISTINCT session_id, 2 AS anchor FROM rows"))
def turn_context(spark, d):
    m = context.logical_turns(star.messages(spark, d))
    return context.around(m, m.select("session_id").distinct().withColumn("turn", F.lit(2)), "turn", 2, 1).select(*_CONTEXT)


@query("message_context", _context_sql("sequence", 2, 2, _TURNS, "SELECT session_id, sequence AS anchor FROM rows WHERE role = 'assistant' AND sequence % 3 = 0"))
def message_context(spark, d):
    m = context.logical_turns(star.messages(spark, d))
    return context.around(m, m.filter("role = 'assistant' AND sequence % 3 = 0").select("session_id", "sequence"), "sequence", 2, 2).select(*_CONTEXT)


@query("context_for_hits", _context_sql("sequence", 1, 1, _TURNS, "SELECT session_id, sequence AS anchor FROM rows WHERE contains(text, 'the')"))
def context_for_hits(spark, d):
    m = context.logical_turns(star.messages(spark, d))
    return context.around(m, m.filter(f.contains(F.col("content"), "the")).select("session_id", "sequence"), "sequence", 1, 1).select(*_CONTEXT)


@query("context_totals", "SELECT count(*) AS total_messages, coalesce(min(turn), 0) AS first, coalesce(max(turn), 0) AS last FROM conversations WHERE conv_id = 1 AND turn BETWEEN 0 AND 3")
def context_totals(spark, d):
    return context.context_totals(star.table(spark, d, "conversations").filter("conv_id = 1 AND turn BETWEEN 0 AND 3"), "turn")


_GAPS = f"WITH {ACTIVITY_SQL}, wanted AS (SELECT o_orderkey AS session_id, unnest(range(8)) AS sequence FROM orders), gaps AS (SELECT session_id, CAST(sequence AS INTEGER) AS sequence FROM wanted ANTI JOIN activity USING (session_id, sequence))"


@query("missing_sequences", _GAPS + " SELECT * FROM gaps")
def missing_sequences(spark, d):
    expected = star.sessions(spark, d, counted=False).select("session_id", F.lit(8).alias("expected"))
    return context.missing_sequences(star.numbered_activity(spark, d), expected)


@query("sync_gaps", _GAPS + " SELECT session_id, 8 AS expected, CAST(count(*) AS INTEGER) AS n_missing, array_to_string(list(sequence ORDER BY sequence), ',') AS missing FROM gaps GROUP BY 1 UNION ALL SELECT o_orderkey, 8, 0, '' FROM orders WHERE o_orderkey NOT IN (SELECT session_id FROM gaps)")
def sync_gaps(spark, d):
    expected = star.sessions(spark, d, counted=False).select("session_id", F.lit(8).alias("expected"))
    return context.sync_gaps(star.numbered_activity(spark, d), expected).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


# -- events ---------------------------------------------------------------------------------------------------


@query("event_type_hist", "SELECT coalesce(event_type, '?') AS event_type, split_part(coalesce(event_type, '?'), ':', 1) AS category, count(*) AS n FROM events GROUP BY 1")
def event_type_hist(spark, d):
    return events.event_types(star.events(spark, d))


@query("event_categories", "SELECT split_part(event_type, ':', 1) AS category, count(DISTINCT event_type) AS n_types, CAST(count(*) AS BIGINT) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS types FROM events GROUP BY 1")
def event_categories(spark, d):
    return events.event_categories(star.events(spark, d)).withColumn("types", F.array_join("types", ","))


@query("search_events", "SELECT event_id AS sequence, user_id, event_type AS event, ts, event_type AS content, CAST(1.0 AS DOUBLE) AS score FROM events WHERE event_type = 'click' AND ts >= TIMESTAMP '2024-01-02' ORDER BY ts DESC, user_id, event_id LIMIT 50")
def search_events(spark, d):
    return events.search_events(star.events(spark, d), event_type="click", start_date="2024-01-02").select("sequence", "user_id", "event", "ts", "content", "score")


@query("events_json_filter", "SELECT event_id AS sequence, event_type AS event, ts FROM events WHERE json_extract_string(props, '$.k') = '7' ORDER BY ts DESC, event_id LIMIT 100")
def events_json_filter(spark, d):
    rows = star.events(spark, d).filter(f.json_equals("data", "$.k", 7))
    return rows.orderBy(F.col("ts").desc(), "sequence").limit(100).select("sequence", "event", "ts")


@query("events_by_prefix", "WITH e AS (SELECT event_id AS sequence, event_type || ':' || CAST(event_id % 3 AS VARCHAR) AS event FROM events) SELECT * FROM e WHERE starts_with(event, 'click:')")
def events_by_prefix(spark, d):
    rows = star.events(spark, d).select("sequence", F.concat_ws(":", "event", (F.col("sequence") % 3).cast("string")).alias("event"))
    return rows.filter(f.category("click"))


# -- vectors --------------------------------------------------------------------------------------------------


def _first_vector(spark, d):
    return star.vectors(spark, d, "vec_id").filter("id = 0").select(F.lit(0).alias("query_id"), F.col("vector").alias("query"))


def _first_values(spark, d) -> list[float]:
    return list(_first_vector(spark, d).first().query)


@query("cosine_topk", f"SELECT v.vec_id AS id, round({COSINE_SQL.format(a='v.embedding', b='q.embedding')}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COSINE_SQL.format(a='v.embedding', b='q.embedding')} DESC, v.vec_id LIMIT 20")
def cosine_topk(spark, d):
    found = vectors.nearest(star.vectors(spark, d, "vec_id"), _first_values(spark, d), 20)
    return found.select("id", F.round("score", 6).alias("score"))


@query("vector_search_best_per_parent", f"""WITH s AS (SELECT q.vec_id AS query_id, v.label AS parent_id, v.vec_id AS id, {COSINE_SQL.format(a='v.embedding', b='q.embedding')} AS score FROM embeddings v, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < 8) q),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY query_id, parent_id ORDER BY score DESC, id) = 1)
SELECT query_id, CAST(parent_id AS BIGINT) AS parent_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS INTEGER) AS rank FROM best QUALIFY rank <= 5""")
def vector_search_best_per_parent(spark, d):
    q = star.vectors(spark, d, "vec_id").filter("id < 8").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))
    return vectors.vector_search_many(star.vectors(spark, d), F.broadcast(q), 5).select("query_id", "parent_id", "id", F.round("score", 6).alias("score"), "rank")


@query("vectors_with_context", "SELECT v.vec_id AS id, v.label AS parent_id, count(*) OVER (PARTITION BY v.label) AS n_siblings, c.role FROM embeddings v JOIN (SELECT conv_id, role FROM conversations WHERE turn = 0) c ON c.conv_id = v.label")
def vectors_with_context(spark, d):
    first = star.table(spark, d, "conversations").filter("turn = 0").select(F.col("conv_id").alias("id"), "role")
    rows = vectors.with_context(star.vectors(spark, d), first)
    return rows.withColumns({"n_siblings": F.count("*").over(Window.partitionBy("parent_id")), "parent_id": F.col("parent_id").cast("int")}).select("id", "parent_id", "n_siblings", "role")


def _mmr_sql(k: int) -> str:
    ctes = [f"c AS (SELECT row_number() OVER (ORDER BY vec_id) AS p, vec_id, embedding AS v FROM embeddings WHERE vec_id BETWEEN 1 AND 40), q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0), s AS (SELECT p, vec_id, c.v, {COSINE_SQL.format(a='c.v', b='q.v')} AS r FROM c, q)"]
    for n in range(1, k + 1):
        if n == 1:
            ctes.append("p1 AS (SELECT p, vec_id, v, 1 AS mmr_rank FROM s ORDER BY 0.7 * r + 0.3 DESC, p LIMIT 1)")
        else:
            ctes.append(f"x{n} AS (SELECT s.p, s.vec_id, s.v, any_value(s.r) AS r, avg({COSINE_SQL.format(a='s.v', b='t.v')}) AS m FROM s, p{n - 1} t WHERE s.p NOT IN (SELECT p FROM p{n - 1}) GROUP BY 1, 2, 3), p{n} AS (SELECT * FROM p{n - 1} UNION ALL SELECT * FROM (SELECT p, vec_id, v, {n} AS mmr_rank FROM x{n} ORDER BY 0.7 * r + 0.3 * (1 - m) DESC, p LIMIT 1))")
    return f"WITH {', '.join(ctes)} SELECT vec_id AS id, CAST(mmr_rank AS INTEGER) AS mmr_rank FROM p{k}"


@query("mmr_k3", _mmr_sql(3))
def mmr_k3(spark, d):
    v = star.vectors(spark, d, "vec_id")
    rows = v.filter("id BETWEEN 1 AND 40").withColumn("position", F.col("id")).crossJoin(_first_vector(spark, d))
    return rerank(rows.select("query_id", "position", "vector", "query", "id"), 3, 0.7).select("id", "mmr_rank")


# -- text -----------------------------------------------------------------------------------------------------


@query("full_text_search", "SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS sequence, text AS content, CAST(1.0 AS DOUBLE) AS score, 'full_text' AS source FROM conversations WHERE contains(text, 'th') AND role IN ('user', 'assistant') ORDER BY conv_id, turn LIMIT 200")
def full_text_search(spark, d):
    options = search.TranscriptSearchOptions("th", search_type="full_text")
    return search.search_transcripts(star.messages(spark, d), None, options, limit=200).select("session_id", "sequence", "content", "score", "source")


@query("full_text_all_roles", "SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS sequence FROM conversations WHERE contains(lower(text), 'th') ORDER BY conv_id, turn LIMIT 150")
def full_text_all_roles(spark, d):
    options = search.TranscriptSearchOptions("TH", search_in_user=False, search_in_assistant=False, search_type="full_text")
    return search.full_text(star.messages(spark, d), None, options, 150, case_insensitive=True).select("session_id", "sequence")


@query("extract_content", "SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS sequence, CASE WHEN role = 'user' THEN 'user_query' ELSE 'assistant_response' END AS content_type, text AS source_text FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''")
def extract_content(spark, d):
    return text.unpivoted(text.extracted(star.messages(spark, d)), ["session_id", "sequence"])


@query("content_type_counts", "SELECT CAST(sum(CASE WHEN role = 'user' AND text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS user_query, CAST(sum(CASE WHEN role = 'assistant' AND text <> '' THEN 1 ELSE 0 END) AS BIGINT) AS assistant_response, CAST(0 AS BIGINT) AS assistant_thinking, CAST(0 AS BIGINT) AS tool_output FROM conversations")
def content_type_counts(spark, d):
    return text.content_type_counts(text.extracted(star.messages(spark, d)))


@query("sentence_split", "SELECT item_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda s: trim(s) <> '')) AS INTEGER) AS n_sentences FROM benchmark")
def sentence_split(spark, d):
    return star.table(spark, d, "benchmark").select("item_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query("line_split", """WITH lines AS (SELECT item_id, i, string_split(text, chr(10))[i] AS line
  FROM benchmark, unnest(range(1, CAST(len(string_split(text, chr(10))) AS BIGINT) + 1)) AS u(i))
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS INTEGER) AS line_no, line,
  CAST(len(regexp_extract_all(line, '\\S+')) AS INTEGER) AS token_count FROM lines WHERE trim(line) <> ''""")
def line_split(spark, d):
    rows = star.table(spark, d, "benchmark").select("item_id", F.lit("tool_output").alias("content_type"), F.col("text").alias("source_text"))
    return embed.pieces(rows, CHUNKER, ("item_id",)).select("item_id", F.col("piece_index").alias("line_no"), F.col("piece").alias("line"), "token_count")


CHUNKER = Chunker(WordCounter(), Limits(embed=400, target=200, overlap=30, least=20))


@query("chunk_documents")
def chunk_documents(spark, d):
    rows = star.table(spark, d, "documents").select("doc_id", F.lit("assistant_response").alias("content_type"), F.col("text").alias("source_text"))
    return embed.chunked(rows, CHUNKER, ("doc_id",))


@query("token_truncation", "SELECT item_id, CAST(len(regexp_extract_all(text, '\\S+')) AS INTEGER) AS n_tokens, regexp_extract(text, '^\\s*(\\S+\\s+){0,9}\\S+') AS head FROM benchmark")
def token_truncation(spark, d):
    return with_tokens(star.table(spark, d, "benchmark"), WordCounter(), 10).select("item_id", "n_tokens", "head")


# -- embedding and hybrid search ------------------------------------------------------------------------------

PROVIDER = embed.HashProvider()


def _message_vectors(spark, d):
    return embed.message_vectors(star.messages(spark, d).withColumn("session_id", F.col("session_id").cast("string")), PROVIDER)


@query("embedding_pipeline", """SELECT CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) || '_' || t AS id, CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) AS parent_id,
  regexp_replace(t, '_0$', '') AS content_type, 0 AS chunk_index, 1 AS total_chunks,
  CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')) AS INTEGER) AS token_count, 64 AS dimensions
FROM (SELECT *, CASE role WHEN 'user' THEN 'user_query_0' WHEN 'assistant' THEN 'assistant_response_0' WHEN 'tool' THEN 'tool_output_0' END AS t FROM conversations) WHERE t IS NOT NULL AND text <> ''""")
def embedding_pipeline(spark, d):
    found = _message_vectors(spark, d)
    return found.select("id", "parent_id", "content_type", "chunk_index", "total_chunks", "token_count", F.size("vector").alias("dimensions"))


STORED_SQL = """m AS (SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS sequence, CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) AS id,
  role, text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations),
v AS (SELECT m.id AS parent_id, CASE role WHEN 'user' THEN 'user_query' WHEN 'assistant' THEN 'assistant_response' ELSE 'tool_output' END AS content_type,
  text AS source_text, embedding AS vec FROM m JOIN embeddings ON vec_id = n),
q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT parent_id, content_type, {score} AS score FROM v, q)""".format(score=COSINE_SQL.format(a="v.vec", b="q.v"))


@query("semantic_search", f"""WITH {STORED_SQL} SELECT session_id, sequence, round(score, 6) AS score FROM scored JOIN m ON id = parent_id
WHERE content_type IN ('user_query', 'assistant_response', 'assistant_thinking') ORDER BY scored.score DESC, parent_id LIMIT 20""")
def semantic_search(spark, d):
    options = search.TranscriptSearchOptions("the of and", search_type="semantic")
    found = search.search_transcripts(star.messages(spark, d), star.message_vectors(spark, d), options, lambda q: _first_values(spark, d), 20)
    return found.select("session_id", "sequence", F.round("score", 6).alias("score"))


def _legs_sql(word: str, limit: int) -> str:
    """The transcript leg looks at assistants alone, the chunk leg at what assistants and tools said."""
    return f"""t AS (SELECT session_id, sequence, id, row_number() OVER (ORDER BY session_id, sequence) AS k FROM m WHERE contains(text, '{word}') AND role = 'assistant' QUALIFY k <= {limit}),
c AS (SELECT session_id, sequence, id, row_number() OVER (ORDER BY id) AS o FROM m JOIN v ON parent_id = id WHERE contains(source_text, '{word}') AND content_type IN ('assistant_response', 'tool_output') QUALIFY o <= {limit}),
words AS (SELECT session_id, sequence, id, 'full_text' AS source, 0 AS leg, k FROM t
  UNION ALL SELECT session_id, sequence, id, 'full_text_chunk', 1, row_number() OVER (ORDER BY session_id, sequence) FROM c),
texts AS (SELECT *, row_number() OVER (ORDER BY leg, k) AS position FROM (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY session_id, sequence ORDER BY leg, k) = 1) QUALIFY position <= {limit})"""


_WORD = "ther re"
_ASSISTANT = {"search_in_user": False, "search_in_thinking": False, "search_in_tool": True}


@query("full_text_two_legs", f"""WITH {STORED_SQL}, {_legs_sql("th", 250)} SELECT session_id, sequence, source, CAST(position AS INTEGER) AS position FROM texts""")
def full_text_two_legs(spark, d):
    options = search.TranscriptSearchOptions("th", search_type="full_text", **_ASSISTANT)
    found = search.search_transcripts(star.messages(spark, d), star.message_vectors(spark, d), options, limit=250)
    return found.select("session_id", "sequence", "source", "position")


def _hybrid_sql(word: str, k: int) -> str:
    wide = 3 * k
    like = lambda a, b: f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0 ELSE {COSINE_SQL.format(a=a, b=b)} END"
    ctes = [f"""{STORED_SQL}, {_legs_sql(word, wide)},
s AS (SELECT session_id, sequence, id, score, row_number() OVER (ORDER BY score DESC, parent_id) AS o FROM scored JOIN m ON id = parent_id WHERE content_type IN ('assistant_response', 'tool_output') QUALIFY o <= {wide}),
both_ AS (SELECT session_id, sequence, id, source, 1.0 AS score, 0 AS leg, row_number() OVER (ORDER BY session_id, sequence) AS k FROM texts
  UNION ALL SELECT session_id, sequence, id, 'semantic', score, 1, row_number() OVER (ORDER BY score DESC, session_id, sequence) FROM s),
c1 AS (SELECT *, row_number() OVER (ORDER BY leg, k) AS p FROM (SELECT * FROM both_ QUALIFY row_number() OVER (PARTITION BY session_id, sequence ORDER BY leg, k) = 1) QUALIFY p <= {2 * wide}),
x AS (SELECT c1.*, v.vec AS w, {like("v.vec", "q.v")} AS r FROM c1 LEFT JOIN v ON v.parent_id = c1.id, q)"""]
    for n in range(1, k + 1):
        if n == 1:
            ctes.append("p1 AS (SELECT p, w, 1 AS mmr_rank FROM x ORDER BY 0.7 * r + 0.3 DESC, p LIMIT 1)")
        else:
            ctes.append(f"y{n} AS (SELECT x.p, any_value(x.w) AS w, any_value(x.r) AS r, avg({like('x.w', 't.w')}) AS m FROM x, p{n - 1} t WHERE x.p NOT IN (SELECT p FROM p{n - 1}) GROUP BY 1)")
            ctes.append(f"p{n} AS (SELECT * FROM p{n - 1} UNION ALL SELECT * FROM (SELECT p, w, {n} AS mmr_rank FROM y{n} ORDER BY 0.7 * r + 0.3 * (1 - m) DESC, p LIMIT 1))")
    return f"WITH {', '.join(ctes)} SELECT session_id, sequence, source, round(score, 6) AS score, CAST(mmr_rank AS INTEGER) AS mmr_rank FROM p{k} JOIN x USING (p)"


@query("hybrid_search", _hybrid_sql(_WORD, 4))
def hybrid_search(spark, d):
    options = search.TranscriptSearchOptions(_WORD, search_type="hybrid", **_ASSISTANT)
    found = search.search_transcripts(star.messages(spark, d), star.message_vectors(spark, d), options, lambda q: _first_values(spark, d), 4)
    return found.select("session_id", "sequence", "source", F.round("score", 6).alias("score"), "mmr_rank")


@query("distinct_text_hashes", "SELECT DISTINCT sha256('m:' || text) AS text_hash FROM conversations WHERE text IS NOT NULL")
def distinct_text_hashes(spark, d):
    return star.table(spark, d, "conversations").filter("text IS NOT NULL").select(F.sha2(F.concat(F.lit("m:"), "text"), 256).alias("text_hash")).distinct()


# -- writes ---------------------------------------------------------------------------------------------------


@query("upsert_sessions", "SELECT o_custkey AS user_id, CAST(o_orderstatus AS VARCHAR) AS session_id, min_by(o_orderdate, o_orderkey) AS created, max_by(o_orderpriority, o_orderkey) AS project_slug, max_by(o_totalprice, o_orderkey) AS metadata, 0 AS turn_count FROM orders GROUP BY 1, 2")
def upsert_sessions(spark, d):
    o = star.table(spark, d, "orders")
    log = o.select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("session_id"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("project_slug"), F.col("o_totalprice").alias("metadata"), F.lit(None).cast("int").alias("turn_count"), F.col("o_orderkey").alias("order"))
    stored, new = log.filter("order % 2 = 0"), log.filter("order % 2 = 1")
    both = stored.unionByName(new).withColumn("turn_count", F.coalesce("turn_count", F.lit(0)))
    return upsert.fold(both, upsert.SESSION_KEY, "order", upsert.SESSION_FIRST)


@query("upsert_messages", f"WITH {ACTIVITY_SQL} SELECT 'u' AS user_id, session_id, CAST(sequence AS INTEGER) AS sequence, CASE WHEN sequence < 2 THEN 'new' ELSE role END AS role, 'h0' AS host_id FROM activity")
def upsert_messages(spark, d):
    a = star.numbered_activity(spark, d).select(F.lit("u").alias("user_id"), "session_id", "sequence", "role", F.lit("h0").alias("host_id"))
    new = a.filter("sequence < 2").withColumns({"role": F.lit("new"), "host_id": F.lit("h1")})
    return upsert.upsert_messages(a, new, "sequence")


@query("event_truncation", "SELECT event_id, CAST(octet_length(encode(props)) AS INTEGER) AS data_size_bytes, octet_length(encode(props)) > 8 AS data_truncated, CASE WHEN octet_length(encode(props)) > 8 THEN '{}' ELSE props END AS data FROM events")
def event_truncation(spark, d):
    return upsert.event_rows(star.table(spark, d, "events").select("event_id", F.col("props").alias("data")), max_bytes=8)


@query("delete_session", "SELECT l_orderkey AS session_id, l_linenumber AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_session(spark, d):
    lines = star.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("n"))
    gone = star.table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("session_id"))
    return upsert.delete_sessions({"lines": lines}, gone, ("session_id",))["lines"]


@query("store_vectors_replace", "SELECT vec_id AS id, CAST(label AS BIGINT) AS parent_id, 'old' AS model FROM embeddings WHERE label NOT IN (SELECT label FROM embeddings WHERE vec_id < 5) UNION ALL SELECT vec_id, CAST(label AS BIGINT), 'new' FROM embeddings WHERE vec_id < 5")
def store_vectors_replace(spark, d):
    v = star.vectors(spark, d).select("id", "parent_id")
    return upsert.replace_vectors(v.withColumn("model", F.lit("old")), v.filter("id < 5").withColumn("model", F.lit("new")))


@query("unpivot_vectors", "SELECT CAST(vec_id AS VARCHAR) || '_' || t || '_0' AS id, CAST(vec_id AS VARCHAR) AS parent_id, t AS content_type, 0 AS chunk_index, len(embedding) AS dimensions FROM embeddings, (VALUES ('user_query'), ('tool_output')) AS x(t) WHERE t = 'user_query' OR label > 4")
def unpivot_vectors(spark, d):
    v = star.table(spark, d, "embeddings")
    none = F.lit(None).cast("array<float>")
    wide = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("user_query_vector"), none.alias("assistant_response_vector"), none.alias("assistant_thinking_vector"), F.when(F.col("label") > 4, F.col("embedding")).alias("tool_output_vector"))
    return upsert.unpivot_vectors(wide).withColumn("dimensions", F.size("vector").cast("long")).drop("vector")


@query("backfill_candidates", "SELECT CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) AS id FROM conversations WHERE turn % 2 = 1 OR turn % 4 = 0")
def backfill_candidates(spark, d):
    m = star.messages(spark, d)
    done = m.filter("sequence % 2 = 0").select(F.col("id").alias("parent_id"), F.when(F.col("sequence") % 4 != 0, F.array(F.lit(1.0))).alias("vector"))
    return upsert.unembedded(m, done).select("id")


@query("upsert_session_batch", "SELECT o_custkey AS user_id, CAST(o_orderstatus AS VARCHAR) AS session_id, min_by(o_orderdate, o_orderkey) AS created, max_by(o_orderpriority, o_orderkey) AS project_slug, 0 AS turn_count FROM orders GROUP BY 1, 2")
def upsert_session_batch(spark, d):
    """Several versions of a session in one batch: created from the first, the rest from the last."""
    o = star.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("session_id"), F.col("o_orderdate").alias("created"), F.col("o_orderpriority").alias("project_slug"), F.lit(None).cast("int").alias("turn_count"), F.col("o_orderkey").alias("order"))
    return upsert.upsert_sessions(None, o, "order").drop("order")


@query("upsert_events", "SELECT user_id, event_id AS sequence, CASE WHEN event_id % 5 = 0 THEN 'new' ELSE event_type END AS event, CASE WHEN event_id % 5 = 0 THEN CAST(octet_length(encode(props)) AS INTEGER) END AS data_size_bytes FROM events")
def upsert_events(spark, d):
    e = star.events(spark, d).drop("value")
    new = e.filter("sequence % 5 = 0").withColumn("event", F.lit("new"))
    return upsert.upsert_events(e, new, "sequence").select("user_id", "sequence", "event", "data_size_bytes")


@query("store_precomputed_vectors", "SELECT CAST(vec_id AS VARCHAR) || '_tool_output_0' AS id, 0 AS chunk_index, 1 AS total_chunks, 0 AS span_start, CAST(vec_id % 7 AS INTEGER) AS span_end, 'm' AS embedding_model FROM embeddings")
def store_precomputed_vectors(spark, d):
    v = star.vectors(spark, d, "vec_id").withColumns({"content_type": F.lit("tool_output"), "source_text": F.repeat(F.lit("x"), (F.col("id") % 7).cast("int"))})
    return upsert.precomputed_vectors(v, "m").select("id", "chunk_index", "total_chunks", "span_start", "span_end", "embedding_model")


@query("vector_flags", "SELECT CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) AS id, turn % 4 = 2 AS has_vectors FROM conversations")
def vector_flags(spark, d):
    m = star.messages(spark, d)
    done = m.filter("sequence % 2 = 0").select(F.col("id").alias("parent_id"), F.when(F.col("sequence") % 4 != 0, F.array(F.lit(1.0))).alias("vector"))
    return upsert.with_vector_flag(upsert.add_vector_flag(m), done).select("id", "has_vectors")


@query("oversize_guard", "SELECT CAST(conv_id AS VARCHAR) || '_msg_' || CAST(turn AS VARCHAR) AS id, octet_length(encode(text)) > 200 AS content_truncated, CASE WHEN octet_length(encode(text)) > 200 THEN '[content of ' || octet_length(encode(text)) || ' bytes left out]' ELSE text END AS content FROM conversations")
def oversize_guard(spark, d):
    return upsert.oversize_guard(star.messages(spark, d), 200).select("id", "content_truncated", "content")


_BLOCK_ROWS = "rows AS (SELECT conv_id AS session_id, CAST(turn AS INTEGER) AS sequence, CASE WHEN turn % 5 = 4 THEN 'tool' ELSE role END AS role, text, turn % 3 = 1 AS blocks FROM conversations)"


@query("extract_blocks", f"""WITH {_BLOCK_ROWS} SELECT session_id, sequence, CASE role WHEN 'user' THEN 'user_query' WHEN 'assistant' THEN 'assistant_response' ELSE 'tool_output' END AS content_type,
  CASE WHEN role = 'assistant' AND blocks THEN text || chr(10) || chr(10) || 'more' WHEN role = 'tool' THEN substr(text, 1, 10000) ELSE text END AS source_text
FROM rows WHERE role IN ('user', 'assistant', 'tool') AND text <> '' UNION ALL SELECT session_id, sequence, 'assistant_thinking', 'thought ' || CAST(sequence AS VARCHAR) FROM rows WHERE role = 'assistant' AND blocks""")
def extract_blocks(spark, d):
    return text.unpivoted(text.extracted(star.block_messages(spark, d)), ["session_id", "sequence"])


@query("block_type_counts", f"""WITH {_BLOCK_ROWS} SELECT CAST(count(*) FILTER (role = 'user' AND text <> '') AS BIGINT) AS user_query, CAST(count(*) FILTER (role = 'assistant' AND text <> '') AS BIGINT) AS assistant_response,
  CAST(count(*) FILTER (role = 'assistant' AND blocks) AS BIGINT) AS assistant_thinking, CAST(count(*) FILTER (role = 'tool' AND text <> '') AS BIGINT) AS tool_output FROM rows""")
def block_type_counts(spark, d):
    return text.content_type_counts(text.extracted(star.block_messages(spark, d)))


@query("display_content", f"""WITH {_BLOCK_ROWS} SELECT session_id, sequence, CASE WHEN role = 'assistant' AND blocks
  THEN text || chr(10) || '[thinking] thought ' || CAST(sequence AS VARCHAR) || chr(10) || '[tool_use: ls]' || chr(10) || 'more' ELSE text END AS content FROM rows""")
def display_content(spark, d):
    return star.block_messages(spark, d).select("session_id", "sequence", text.display(F.col("content")).alias("content"))


@query("context_without_tools", f"""WITH {_BLOCK_ROWS}, talk AS (SELECT * FROM rows WHERE role <> 'tool')
SELECT session_id, sequence, role, 3 AS anchor FROM talk WHERE sequence BETWEEN 1 AND 5""")
def context_without_tools(spark, d):
    m = star.block_messages(spark, d)
    hits = m.select("session_id").distinct().withColumn("sequence", F.lit(3))
    return context.around(m, hits, "sequence", 2, 2, include_tools=False).select("session_id", "sequence", "role", "anchor")


@query("type_lists", f"""WITH {STORED_SQL} SELECT id, CASE WHEN role = 'user' THEN len(vec) END AS user_query, CASE WHEN role = 'assistant' THEN len(vec) END AS assistant_response FROM m LEFT JOIN v ON parent_id = id""")
def type_lists(spark, d):
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long").alias(c.removesuffix("_vector"))
    return embed.type_lists(star.messages(spark, d), star.message_vectors(spark, d)).select("id", size("user_query_vector"), size("assistant_response_vector"))


@query("without_vectors", "SELECT vec_id AS id, CAST(label AS BIGINT) AS parent_id, 'user_query' AS content_type FROM embeddings")
def without_vectors(spark, d):
    return f.no_vectors(star.vectors(spark, d))


@query("activity_statistics", "SELECT 'messages' AS dimension, NULL AS key, count(*) AS n FROM conversations UNION ALL SELECT 'events', NULL, count(*) FROM events UNION ALL SELECT 'event_type', event_type, count(*) FROM events GROUP BY 2 UNION ALL SELECT 'tool', 't' || CAST(event_id % 3 AS VARCHAR), count(*) FROM events GROUP BY 2")
def activity_statistics(spark, d):
    return sessions.activity_statistics(star.messages(spark, d), star.tool_events(spark, d))


@query("search_tool_events", """SELECT event_id AS sequence, event_type AS event, ts, event_type AS content FROM events WHERE event_id % 3 = 1 AND event_id % 2 = 0 AND event_id % 5 = 0
  AND user_id < 500 AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, user_id, event_id LIMIT 40""")
def search_tool_events(spark, d):
    e = star.tool_events(spark, d)
    found = events.search_events(e, tool_name="t1", model="m0", provider="p", level="info", project_slug="few", end_date="2024-01-25", limit=40)
    return found.select("sequence", "event", "ts", "content")


@query("event_display", """SELECT event_id AS sequence, CASE event_id % 4 WHEN 0 THEN 'tool:pre | tool=t' || CAST(event_id % 3 AS VARCHAR) WHEN 1 THEN 'llm:request | model=m' || CAST(event_id % 2 AS VARCHAR) || ' | provider=p'
  WHEN 2 THEN 'delegate:agent_completed | agent=a' ELSE event_type END AS shown FROM events""")
def event_display(spark, d):
    kinds = F.expr("CASE sequence % 4 WHEN 0 THEN 'tool:pre' WHEN 1 THEN 'llm:request' WHEN 2 THEN 'delegate:agent_completed' ELSE event END")
    return star.tool_events(spark, d).select("sequence", text.event_display(kinds, F.col("data")).alias("shown"))


@query("vector_search_filtered", f"""WITH {STORED_SQL}, u AS (SELECT parent_id, session_id, score FROM scored JOIN m ON id = parent_id WHERE session_id IN (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) >= 4))
SELECT parent_id, round(score, 6) AS score FROM u ORDER BY u.score DESC, parent_id LIMIT 15""")
def vector_search_filtered(spark, d):
    """Filters that only sessions know: vectors are joined to them by their own session id."""
    m = star.messages(spark, d)
    of_sessions = m.groupBy("session_id").agg(F.count("*").alias("turn_count")).withColumns({c: F.lit(None).cast("string") for c in ("project_slug", "bundle", "metadata")}).withColumn("created", F.lit(None).cast("timestamp"))
    own = f.on_vectors(star.message_vectors(spark, d), "", SearchFilters(min_turn_count=4), m, of_sessions)
    return vectors.vector_search(own, _first_values(spark, d), 15).select("parent_id", F.round("score", 6).alias("score"))


# -- event-time windows ---------------------------------------------------------------------------------------


@query("tumbling_counts", "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end, event_type AS event, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def tumbling_counts(spark, d):
    return _plain(windows.window_counts(star.events(spark, d))).withColumn("total", F.round("total", 4))


@query("sliding_counts", "WITH s AS (SELECT time_bucket(INTERVAL '30 minutes', ts) AS b, event_type AS event, value FROM events), w AS (SELECT unnest([b - INTERVAL '30 minutes', b]) AS window_start, event, value FROM s) SELECT window_start, window_start + INTERVAL '1 hour' AS window_end, event, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2, 3")
def sliding_counts(spark, d):
    return _plain(windows.window_counts(star.events(spark, d), slide="30 minutes")).withColumn("total", F.round("total", 4))


@query("user_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def user_sessions(spark, d):
    return _plain(windows.sessionized(star.events(spark, d)))


@query("deduplicated_events", "SELECT DISTINCT user_id, event_type AS event FROM events")
def deduplicated_events(spark, d):
    return windows.deduplicated(star.events(spark, d), ["user_id", "event"]).select("user_id", "event")


def _plain(df: DataFrame) -> DataFrame:
    """Times without a zone, as in the tables."""
    return df.select(*(F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in df.dtypes))
