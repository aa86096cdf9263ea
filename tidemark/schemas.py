"""Schemas of the stored tables. Keys are (user_id, session_id) and, below a session, the sequence."""

from pyspark.sql import types as T

S, I, L, D, B, TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _of(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


SESSIONS = _of(user_id=S, host_id=S, session_id=S, project_slug=S, bundle=S, created=TS, updated=TS, turn_count=I, metadata=S, synced_at=TS)
MESSAGES = _of(id=S, user_id=S, host_id=S, project_slug=S, session_id=S, sequence=I, role=S, content=S, turn=I, ts=TS, synced_at=TS)
EVENTS = _of(id=S, user_id=S, host_id=S, project_slug=S, session_id=S, sequence=I, ts=TS, lvl=S, event=S, turn=I, data=S, data_truncated=B, data_size_bytes=I, synced_at=TS)
VECTORS = _of(id=S, parent_id=S, user_id=S, session_id=S, project_slug=S, content_type=S, chunk_index=I, total_chunks=I, span_start=I, span_end=I, token_count=I, source_text=S, vector=T.ArrayType(D), embedding_model=S, created_at=TS)
CHUNK = _of(text=S, span_start=I, span_end=I, chunk_index=I, total_chunks=I, token_count=I)
BLOCKS = T.ArrayType(_of(type=S, text=S, thinking=S, name=S, content=S))

TABLES = {"sessions": SESSIONS, "transcripts": MESSAGES, "events": EVENTS, "transcript_vectors": VECTORS}
SCHEMA_VERSION = 3
CONTENT_TYPES = ("user_query", "assistant_response", "assistant_thinking", "tool_output")
