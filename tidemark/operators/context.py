"""Windows of turns or messages around a place in a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import filters as f


def lines(rows: DataFrame, user_id: str = "", session_id: str | None = None, project_slug: str | None = None, after_sequence: int | None = None) -> DataFrame:
    """Messages or events of a session from behind a cursor on, in order."""
    wanted = f.every([f.of_user(user_id), f.equals("session_id", session_id), f.equals("project_slug", project_slug), None if after_sequence is None else F.col("sequence") > after_sequence])
    return rows.filter(wanted).orderBy("session_id", "sequence")


def ids(rows: DataFrame, user_id: str = "", session_id: str | None = None) -> DataFrame:
    return rows.filter(f.every([f.of_user(user_id), f.equals("session_id", session_id)])).select("id")


def around(messages: DataFrame, hits: DataFrame, on: str, before: int, after: int, include_tools: bool = True) -> DataFrame:
    """For every hit (session_id, <on>), the messages from `before` ahead of it to `after` behind it.

    position says whether a message is previous, current or following; has_more_before and has_more_after whether
    the session goes on beyond what was found; anchor is the hit's place. Messages without a place are left out of
    turn windows. The range is an equi-join: each hit is spread over the places it asks for.
    """
    rows = messages.filter(F.col(on).isNotNull())
    if not include_tools:
        rows = rows.filter(f.without_tools())
    ends = rows.groupBy("session_id").agg(F.min(on).alias("__first"), F.max(on).alias("__last"))
    spread = hits.select("session_id", F.col(on).alias("anchor")).filter(F.col("anchor").isNotNull()).distinct()
    spread = spread.select("session_id", "anchor", F.explode(F.sequence(F.col("anchor") - before, F.col("anchor") + after)).alias(on))
    found = rows.join(spread, ["session_id", on]).join(ends, "session_id")
    w = Window.partitionBy("session_id", "anchor")
    position = F.when(F.col(on) < F.col("anchor"), "previous").when(F.col(on) == F.col("anchor"), "current").otherwise("following")
    return found.withColumns({"position": position, "has_more_before": F.min(on).over(w) > F.col("__first"), "has_more_after": F.max(on).over(w) < F.col("__last")}).drop("__first", "__last")


def turn_context(messages: DataFrame, session_id, turn: int, before: int = 2, after: int = 1, user_id: str = "", include_tools: bool = True) -> DataFrame:
    rows = messages.filter(f.every([f.of_user(user_id), f.equals("session_id", session_id)]))
    return around(rows, rows.select("session_id").limit(1).withColumn("turn", F.lit(turn)), "turn", before, after, include_tools).orderBy("turn", "sequence")


def message_context(messages: DataFrame, session_id, sequence: int, before: int = 5, after: int = 5, user_id: str = "", include_tools: bool = True) -> DataFrame:
    rows = messages.filter(f.every([f.of_user(user_id), f.equals("session_id", session_id)]))
    return around(rows, rows.select("session_id").limit(1).withColumn("sequence", F.lit(sequence)), "sequence", before, after, include_tools).orderBy("sequence")


def context_totals(context: DataFrame, on: str) -> DataFrame:
    """How many messages each context has and its range, (0, 0) for none."""
    return context.agg(F.count("*").alias("total_messages"), F.coalesce(F.min(on), F.lit(0)).alias("first"), F.coalesce(F.max(on), F.lit(0)).alias("last"))


def logical_turns(messages: DataFrame) -> DataFrame:
    """The turn of each message where only roles are known: how many user messages there were up to it."""
    w = Window.partitionBy("session_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("turn", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).cast("int"))


def missing_sequences(rows: DataFrame, expected: DataFrame, base: int = 0) -> DataFrame:
    """(session_id, sequence) of all that should be there and isn't.

    expected has (session_id, expected); a null count is passed over. Sequences run from base.
    """
    wanted = expected.filter("expected > 0").select("session_id", F.explode(F.sequence(F.lit(base), F.col("expected").cast("int") + base - 1)).alias("sequence"))
    return wanted.join(rows.select("session_id", "sequence"), ["session_id", "sequence"], "left_anti")


def sync_gaps(rows: DataFrame, expected: DataFrame, base: int = 0) -> DataFrame:
    """(session_id, expected, n_missing, missing): the missing sequences of each session as a sorted list."""
    none = F.array().cast("array<int>")
    held = rows.groupBy("session_id").agg(F.collect_set(F.col("sequence").cast("int")).alias("held"))
    out = expected.filter("expected IS NOT NULL").join(held, "session_id", "left")
    wanted = F.when(F.col("expected") > 0, F.sequence(F.lit(base), F.col("expected").cast("int") + base - 1)).otherwise(none)
    out = out.withColumn("missing", F.array_except(wanted, F.coalesce("held", none)))
    return out.select("session_id", "expected", F.size("missing").alias("n_missing"), "missing")
