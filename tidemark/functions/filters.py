"""Filters as columns (F1-F13). A filter that isn't set leaves nothing out."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_COLUMNS = ("vector", "user_query_vector", "assistant_response_vector", "assistant_thinking_vector", "tool_output_vector")


@dataclass(frozen=True)
class SearchFilters:
    project_slug: str | None = None
    session_id: str | None = None
    start_date: datetime | str | None = None
    end_date: datetime | str | None = None
    bundle: str | None = None
    min_turn_count: int | None = None
    max_turn_count: int | None = None
    tags: tuple[str, ...] | None = None


def every(conditions: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def equals(column: str, value) -> Column | None:
    return None if value is None else F.col(column) == F.lit(value)


def of_user(user_id: str, column: str = "user_id") -> Column | None:
    """An empty user stands for all of them."""
    return None if user_id == "" or user_id is None else F.col(column) == F.lit(user_id)


def _time(value) -> Column:
    return F.to_timestamp(F.lit(value)) if isinstance(value, str) else F.lit(value)


def between(column: str, start=None, end=None) -> Column | None:
    """Both ends belong to the range."""
    low = None if start is None else F.col(column) >= _time(start)
    high = None if end is None else F.col(column) <= _time(end)
    return None if low is None and high is None else every([low, high])


def number_between(column: str, low: int | None, high: int | None) -> Column | None:
    """Zero is a bound like any other."""
    return every([None if low is None else F.col(column) >= low, None if high is None else F.col(column) <= high])


def one_of(column: str, values: Iterable | None) -> Column | None:
    return None if values is None else F.col(column).isin(list(values))


def roles(user: bool, assistant: bool, column: str = "role") -> Column | None:
    """Any of the chosen roles; every role if none is chosen."""
    chosen = [r for r, on in (("user", user), ("assistant", assistant)) if on]
    return F.col(column).isin(chosen) if chosen else None


def without_tools(column: str = "role") -> Column:
    """Rows without a role go too, as in SQL."""
    return F.col(column) != "tool"


def contains(column: Column, query: str, case_insensitive: bool = False) -> Column:
    """The query's signs as they stand: no wildcards."""
    return F.lower(column).contains(F.lower(F.lit(query))) if case_insensitive else column.contains(F.lit(query))


def category(event_category: str, column: str = "event") -> Column:
    """Events whose type starts with the category and a colon; "content" is short for "content_block"."""
    prefix = event_category.rstrip(":")
    return F.col(column).startswith(("content_block" if prefix == "content" else prefix) + ":")


def json_equals(column: str, path: str, value) -> Column | None:
    return None if value is None else F.get_json_object(F.col(column), path) == F.lit(str(value))


def no_vectors(df: DataFrame) -> DataFrame:
    return df.drop(*VECTOR_COLUMNS)


def on_sessions(f: SearchFilters, created: str = "created") -> Column:
    return every([
        equals("project_slug", f.project_slug), equals("session_id", f.session_id), equals("bundle", f.bundle),
        between(created, f.start_date, f.end_date), number_between("turn_count", f.min_turn_count, f.max_turn_count),
        None if not f.tags else F.arrays_overlap(F.from_json(F.get_json_object("metadata", "$.tags"), "array<string>"), F.array(*map(F.lit, f.tags))),
    ])


def by_sessions(f: SearchFilters) -> bool:
    """Whether any filter asks for what only sessions know."""
    return f.bundle is not None or f.min_turn_count is not None or f.max_turn_count is not None or bool(f.tags)


def on_vectors(vectors: DataFrame, user_id: str, f: SearchFilters, messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """Filters on vectors by what they know themselves; sessions and, for dates, messages are looked up only if asked
    for, and only their ids."""
    known = {c: v for c, v in (("project_slug", f.project_slug), ("session_id", f.session_id)) if v is not None}
    if user_id:
        known["user_id"] = user_id
    rows = vectors.filter(every([equals(c, v) for c, v in known.items() if c in vectors.columns]))
    if f.start_date is not None or f.end_date is not None or any(c not in vectors.columns for c in known) or by_sessions(f) and "session_id" not in vectors.columns:
        wanted = on_messages(messages.filter(every([of_user(user_id)])), f, sessions)
        return rows.join(wanted.select(F.col("id").alias("parent_id")), "parent_id", "left_semi")
    return _of_sessions(rows, f, sessions)


def _of_sessions(df: DataFrame, f: SearchFilters, sessions: DataFrame | None) -> DataFrame:
    if sessions is None or not by_sessions(f):
        return df
    wanted = sessions.filter(on_sessions(SearchFilters(bundle=f.bundle, min_turn_count=f.min_turn_count, max_turn_count=f.max_turn_count, tags=f.tags)))
    return df.join(wanted.select("session_id"), "session_id", "left_semi")


def on_messages(df: DataFrame, f: SearchFilters, sessions: DataFrame | None = None, ts: str = "ts") -> DataFrame:
    """Filters on rows below sessions; what only sessions know is looked up there by a semi join."""
    df = df.filter(every([equals("project_slug", f.project_slug), equals("session_id", f.session_id), between(ts, f.start_date, f.end_date)]))
    return _of_sessions(df, f, sessions)
