"""Sessions: retrieval, discovery, activity and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as f
from ..functions.filters import SearchFilters

LISTED = ("user_id", "session_id", "project_slug", "bundle", "created", "turn_count")


def get_session(sessions: DataFrame, user_id: str, session_id: str) -> DataFrame:
    return sessions.filter(f.every([f.of_user(user_id), f.equals("session_id", session_id)])).limit(1)


def search_sessions(sessions: DataFrame, user_id: str = "", filters: SearchFilters = SearchFilters(), limit: int = 100) -> DataFrame:
    """The newest sessions that pass; ties go to the least session id."""
    return sessions.filter(f.every([f.of_user(user_id), f.on_sessions(filters)])).orderBy(F.col("created").desc_nulls_last(), F.col("session_id").asc()).limit(limit)


def list_sessions(sessions: DataFrame, user_id: str = "", project_slug: str | None = None, limit: int = 100, offset: int = 0, columns: tuple[str, ...] = LISTED) -> DataFrame:
    page = sessions.filter(f.every([f.of_user(user_id), f.equals("project_slug", project_slug)])).select(*columns)
    return page.orderBy(F.col("created").desc_nulls_last(), F.col("session_id").asc()).offset(offset).limit(limit)


def _distinct(sessions: DataFrame, column: str, condition: Column) -> DataFrame:
    return sessions.filter(condition & F.col(column).isNotNull() & (F.col(column).cast("string") != "")).select(column).distinct().orderBy(column)


def list_users(sessions: DataFrame, filters: SearchFilters = SearchFilters()) -> DataFrame:
    return _distinct(sessions, "user_id", f.on_sessions(filters))


def list_projects(sessions: DataFrame, user_id: str = "", filters: SearchFilters = SearchFilters()) -> DataFrame:
    """The filter's own project doesn't narrow the list."""
    rest = SearchFilters(**{**filters.__dict__, "project_slug": None})
    return _distinct(sessions, "project_slug", f.every([f.of_user(user_id), f.on_sessions(rest)]))


def active_sessions(sessions: DataFrame, messages: DataFrame, user_id: str = "", project_slug: str | None = None, start_date=None, end_date=None, min_turn_count: int | None = None, limit: int = 100) -> DataFrame:
    """Sessions with a message in the range, the last updated first (created where never updated)."""
    active = messages.filter(f.every([f.of_user(user_id) if "user_id" in messages.columns else None, f.equals("project_slug", project_slug) if "project_slug" in messages.columns else None, f.between("ts", start_date, end_date)])).select("session_id")
    wanted = sessions.filter(f.every([f.of_user(user_id), f.equals("project_slug", project_slug), f.number_between("turn_count", min_turn_count, None)]))
    return wanted.join(active, "session_id", "left_semi").orderBy(F.coalesce("updated", "created").desc_nulls_last(), F.col("session_id").asc()).limit(limit)


def session_statistics(sessions: DataFrame, user_id: str = "", filters: SearchFilters = SearchFilters()) -> DataFrame:
    """(dimension, key, n): all sessions, by project and by bundle, in one pass over grouping sets."""
    rows = sessions.filter(f.every([f.of_user(user_id), f.on_sessions(filters)])).select("project_slug", "bundle")
    sets = rows.groupingSets([[], ["project_slug"], ["bundle"]], "project_slug", "bundle").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "project").otherwise("bundle")
    return sets.select(dimension.alias("dimension"), F.when(F.col("g") == 1, F.col("project_slug")).when(F.col("g") == 2, F.col("bundle")).alias("key"), "n")


def activity_statistics(messages: DataFrame, events: DataFrame) -> DataFrame:
    """(dimension, key, n): messages, events, events by type and tools used."""
    tool = F.get_json_object("data", "$.data.tool_name")
    e = events.select("event", tool.alias("tool"))
    return (
        messages.agg(F.count("*").alias("n")).select(F.lit("messages").alias("dimension"), F.lit(None).cast("string").alias("key"), "n")
        .unionByName(e.agg(F.count("*").alias("n")).select(F.lit("events").alias("dimension"), F.lit(None).cast("string").alias("key"), "n"))
        .unionByName(e.groupBy(F.col("event").alias("key")).agg(F.count("*").alias("n")).select(F.lit("event_type").alias("dimension"), "key", "n"))
        .unionByName(e.filter("tool IS NOT NULL").groupBy(F.col("tool").alias("key")).agg(F.count("*").alias("n")).select(F.lit("tool").alias("dimension"), "key", "n"))
    )


def sync_stats(messages: DataFrame, events: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and time ranges of messages and events, each in one pass; `by` gives a row for each session."""
    sides = []
    for source, rows in (("transcripts", messages), ("events", events)):
        sides.append(rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(F.lit(source).alias("source"), *by, "n", "first_ts", "last_ts"))
    return sides[0].unionByName(sides[1])


def bounds(rows: DataFrame, column: str, by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The least and greatest turn or sequence of each session."""
    return rows.groupBy(*by).agg(F.min(column).alias(f"first_{column}"), F.max(column).alias(f"last_{column}"))
