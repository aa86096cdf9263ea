"""Event search and event types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import filters as f
from ..functions.text import event_display


def search_events(events: DataFrame, user_id: str = "", session_id: str | None = None, project_slug: str | None = None, event_type: str | None = None, event_category: str | None = None, tool_name: str | None = None, model: str | None = None, provider: str | None = None, level: str | None = None, start_date=None, end_date=None, limit: int = 50, payload: str = "$.data") -> DataFrame:
    """The latest events that pass. A type wins over a category."""
    kind = f.equals("event", event_type) if event_type is not None else (f.category(event_category) if event_category else None)
    wanted = f.every([
        f.of_user(user_id), f.equals("session_id", session_id), f.equals("project_slug", project_slug), kind,
        f.json_equals("data", f"{payload}.tool_name", tool_name), f.json_equals("data", f"{payload}.model", model), f.json_equals("data", f"{payload}.provider", provider),
        f.equals("lvl", level), f.between("ts", start_date, end_date),
    ])
    rows = events.filter(wanted).orderBy(F.col("ts").desc_nulls_last(), F.col("session_id").asc(), F.col("sequence").asc()).limit(limit)
    return rows.withColumns({"content": event_display(F.col("event"), F.col("data"), payload), "score": F.lit(1.0), "source": F.lit("event_search")})


def event_types(events: DataFrame, user_id: str = "", session_id: str | None = None) -> DataFrame:
    """(event_type, category, n): an event without a type counts as "?"; the category ends at the first colon."""
    kind = F.coalesce("event", F.lit("?"))
    rows = events.filter(f.every([f.of_user(user_id), f.equals("session_id", session_id)]))
    return rows.groupBy(kind.alias("event_type")).agg(F.count("*").alias("n")).select("event_type", F.split_part("event_type", F.lit(":"), F.lit(1)).alias("category"), "n")


def event_categories(events: DataFrame) -> DataFrame:
    """(category, n_types, n, types): the types of each category, sorted."""
    return event_types(events).groupBy("category").agg(F.count("*").alias("n_types"), F.sum("n").alias("n"), F.array_sort(F.collect_list("event_type")).alias("types"))
