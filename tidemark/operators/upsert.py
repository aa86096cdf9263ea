"""Keyed upserts and deletes as folds over rows.

An upsert is the union of what is stored and what comes in, folded by key in one shuffle: the columns that keep
their first value take it from the least version, the others from the greatest. Nothing is updated in place. The shuffle
has as many tasks as the input asks for, each of which sorts its rows once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.layout import by_key
from ..schemas import CONTENT_TYPES

SESSION_KEY, SESSION_FIRST = ("user_id", "session_id"), ("created",)
MESSAGE_KEY, MESSAGE_FIRST = ("user_id", "session_id", "sequence"), ("host_id", "project_slug")
EVENT_KEY = ("user_id", "session_id", "sequence")
MAX_EVENT_BYTES, MAX_CONTENT_BYTES = 400 * 1024, 1_800_000


def fold(log: DataFrame, key: Sequence[str], version: str, first_wins: Sequence[str] = (), keep_version: bool = False) -> DataFrame:
    """One row for each key. Keys may be null. Versions should be unique below a key."""
    first = [c for c in log.columns if c in first_wins]
    last = [c for c in log.columns if c not in first_wins and c not in key and c != version]
    packed = [F.max_by(F.struct(*last), version).alias("__last")] + ([F.min_by(F.struct(*first), version).alias("__first")] if first else [])
    rows = by_key(log, *key).groupBy(*key).agg(*packed, F.max(version).alias(version))
    columns = [F.col(c) if c in key or c == version else F.col(f"__first.{c}" if c in first else f"__last.{c}").alias(c) for c in log.columns]
    return rows.select(*(c for c, name in zip(columns, log.columns) if keep_version or name != version))


def upsert(stored: DataFrame | None, incoming: DataFrame, key: Sequence[str], first_wins: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """stored with incoming put in; rows of incoming that share a key are taken by order (its column, if given)."""
    new = incoming.withColumn("__v", F.struct(F.lit(1).alias("a"), (F.col(order) if order else F.monotonically_increasing_id()).alias("b")))
    if stored is not None:
        kind = dict(new.select("__v.b").dtypes)["b"]
        new = stored.withColumn("__v", F.struct(F.lit(0).alias("a"), F.lit(None).cast(kind).alias("b"))).unionByName(new, allowMissingColumns=True)
    return fold(new, key, "__v", first_wins)


def upsert_sessions(stored: DataFrame | None, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """created keeps its first value, everything else its last; turn_count is 0 where none is given."""
    return upsert(stored, incoming.withColumn("turn_count", F.coalesce("turn_count", F.lit(0))), SESSION_KEY, SESSION_FIRST, order)


def numbered(lines: DataFrame, order: str, start_sequence: int = 0, mark: str = "msg") -> DataFrame:
    """Gives lines of each session their sequence in the given order, whatever they say themselves, and their id."""
    w = Window.partitionBy("user_id", "session_id").orderBy(order)
    rows = by_key(lines, "user_id", "session_id").withColumn("sequence", (F.row_number().over(w) - 1 + start_sequence).cast("int"))
    make = ids.message_id if mark == "msg" else ids.event_id
    return rows.withColumn("id", make(F.col("session_id"), F.col("sequence")))


def upsert_messages(stored: DataFrame | None, incoming: DataFrame, order: str | None = None) -> DataFrame:
    return upsert(stored, incoming, MESSAGE_KEY, MESSAGE_FIRST, order)


def event_rows(lines: DataFrame, line: str = "data", max_bytes: int = MAX_EVENT_BYTES) -> DataFrame:
    """Sizes each raw line; a line beyond max_bytes of UTF-8 is kept as an empty object and marked."""
    size = F.octet_length(line)
    return lines.withColumns({"data_size_bytes": size.cast("int"), "data_truncated": size > max_bytes, line: F.when(size > max_bytes, F.lit("{}")).otherwise(F.col(line))})


def upsert_events(stored: DataFrame | None, incoming: DataFrame, order: str | None = None) -> DataFrame:
    """Events are replaced as a whole."""
    return upsert(stored, event_rows(incoming), EVENT_KEY, (), order)


def oversize_guard(messages: DataFrame, max_bytes: int = MAX_CONTENT_BYTES) -> DataFrame:
    """Replaces content beyond max_bytes by a marker and says so."""
    size = F.octet_length("content")
    return messages.withColumns({"content_truncated": F.coalesce(size > max_bytes, F.lit(False)), "content": F.when(size > max_bytes, F.format_string("[content of %d bytes left out]", size)).otherwise(F.col("content"))})


def replace_vectors(stored: DataFrame | None, incoming: DataFrame, key: Sequence[str] = ("parent_id",)) -> DataFrame:
    """Every vector of a parent that incoming names goes; incoming's come."""
    if stored is None:
        return incoming
    return stored.join(incoming.select(*key).distinct(), list(key), "left_anti").unionByName(incoming, allowMissingColumns=True)


def precomputed_vectors(rows: DataFrame, model: str) -> DataFrame:
    """Vector records of rows (parent_id, content_type, source_text, vector...), each a single chunk over its text."""
    length = F.length(F.coalesce("source_text", F.lit("")))
    out = rows.withColumns({"chunk_index": F.lit(0), "total_chunks": F.lit(1), "span_start": F.lit(0), "span_end": length, "embedding_model": F.lit(model)})
    return out.withColumn("id", ids.vector_id(F.col("parent_id"), F.col("content_type"), F.col("chunk_index")))


def unpivot_vectors(messages: DataFrame, key: str = "id") -> DataFrame:
    """(id, parent_id, content_type, chunk_index, vector) from a column for each content type."""
    pairs = ", ".join(f"'{c}', {c}_vector" for c in CONTENT_TYPES)
    rows = messages.select(F.col(key).cast("string").alias("parent_id"), F.expr(f"stack({len(CONTENT_TYPES)}, {pairs}) AS (content_type, vector)")).filter("vector IS NOT NULL")
    return rows.select(ids.vector_id(F.col("parent_id"), F.col("content_type"), F.lit(0)).alias("id"), "parent_id", "content_type", F.lit(0).alias("chunk_index"), "vector")


def with_vector_flag(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """has_vectors from what is stored: a message has them if every chunk that is kept for it has one."""
    state = vectors.groupBy(F.col("parent_id").alias("id")).agg(F.bool_and(F.col("vector").isNotNull()).alias("__has"))
    return messages.drop("has_vectors").join(state, "id", "left").withColumn("has_vectors", F.coalesce("__has", F.lit(False))).drop("__has")


def add_vector_flag(messages: DataFrame) -> DataFrame:
    """Migration to version 3: the flag, false where it was missing."""
    if "has_vectors" in messages.columns:
        return messages.withColumn("has_vectors", F.coalesce("has_vectors", F.lit(False)))
    return messages.withColumn("has_vectors", F.lit(False))


def delete_sessions(tables: dict[str, DataFrame], gone: DataFrame, key: Sequence[str] = SESSION_KEY) -> dict[str, DataFrame]:
    """All tables without the rows of the given sessions (W7); nulls in a key match each other."""
    marks = gone.select(*(F.col(c).alias(f"__{c}") for c in key)).distinct()
    out = {}
    for name, rows in tables.items():
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key if c in rows.columns]
        on = same[0]
        for c in same[1:]:
            on = on & c
        out[name] = rows.join(marks, on, "left_anti")
    return out


def unembedded(messages: DataFrame, vectors: DataFrame) -> DataFrame:
    """Messages that lack vectors, in order: what a backfill works on."""
    return with_vector_flag(messages, vectors).filter("NOT has_vectors").orderBy("session_id", "sequence")
