"""Ids of messages, events, vectors and partitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import InvalidValue


def message_id(session_id: Column, sequence: Column) -> Column:
    return F.concat(session_id.cast("string"), F.lit("_msg_"), sequence.cast("string"))


def event_id(session_id: Column, sequence: Column) -> Column:
    return F.concat(session_id.cast("string"), F.lit("_evt_"), sequence.cast("string"))


def vector_id(parent_id: Column, content_type: Column, chunk_index: Column) -> Column:
    return F.concat_ws("_", parent_id.cast("string"), content_type, chunk_index.cast("string"))


def partition_key(user_id: Column, project_slug: Column, session_id: Column) -> Column:
    return F.concat_ws("|", user_id.cast("string"), project_slug.cast("string"), session_id.cast("string"))


def sequence_of(id: Column, strict: bool = True) -> Column:
    """The number behind the last _msg_ or _evt_; a malformed id raises, or is null if not strict."""
    found = F.regexp_extract(id, r"^.*_(?:msg|evt)_(-?[0-9]+)$", 1)
    number = F.when(found != "", found.cast("int"))
    if not strict:
        return number
    return F.when(id.isNull(), F.lit(None)).when(number.isNotNull(), number).otherwise(F.raise_error(F.concat(F.lit("malformed id: "), id)).cast("int"))


def parse_sequence(id: str) -> int:
    for mark in ("_msg_", "_evt_"):
        head, found, tail = id.rpartition(mark)
        if found:
            try:
                return int(tail)
            except ValueError:
                break
    raise InvalidValue(f"malformed id: {id}", id=id)
