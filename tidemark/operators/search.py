"""Search over messages: full text, semantic and hybrid."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidValue
from ..functions import filters as f
from ..functions import text
from ..functions.filters import SearchFilters
from .mmr import rerank
from .vectors import vector_search

_TYPE_OF = {"search_in_user": "user_query", "search_in_assistant": "assistant_response", "search_in_thinking": "assistant_thinking", "search_in_tool": "tool_output"}


@dataclass(frozen=True)
class TranscriptSearchOptions:
    query: str
    search_in_user: bool = True
    search_in_assistant: bool = True
    search_in_thinking: bool = True
    search_in_tool: bool = False
    search_type: str = "hybrid"
    mmr_lambda: float = 0.7
    filters: SearchFilters = field(default_factory=SearchFilters)

    @property
    def content_types(self) -> list[str]:
        return [kind for flag, kind in _TYPE_OF.items() if getattr(self, flag)]


def _scoped(rows: DataFrame, user_id: str, options: TranscriptSearchOptions, sessions: DataFrame | None) -> DataFrame:
    return f.on_messages(rows.filter(f.every([f.of_user(user_id)])), options.filters, sessions)


def transcript_leg(messages: DataFrame, options: TranscriptSearchOptions, limit: int, case_insensitive: bool = False) -> DataFrame:
    """Messages that hold the query, the latest first."""
    hit = f.every([f.contains(text.searchable(F.col("content")), options.query, case_insensitive), f.roles(options.search_in_user, options.search_in_assistant)])
    rows = messages.filter(hit).select("id", "session_id", "project_slug", "sequence", "ts")
    rows = rows.orderBy(F.col("ts").desc_nulls_last(), F.col("session_id").asc(), F.col("sequence").asc()).limit(limit)
    nothing = {"matched_text": F.lit(None).cast("string"), "span_start": F.lit(None).cast("int"), "span_end": F.lit(None).cast("int")}
    return rows.withColumns({**nothing, "score": F.lit(1.0), "source": F.lit("full_text")})


def chunk_leg(messages: DataFrame, vectors: DataFrame, options: TranscriptSearchOptions, limit: int, case_insensitive: bool = False) -> DataFrame:
    """Messages one of whose chunks holds the query, with the first such chunk."""
    hit = f.contains(F.col("source_text"), options.query, case_insensitive)
    kinds = f.one_of("content_type", options.content_types) if options.content_types else None
    found = vectors.filter(f.every([hit, kinds])).select("parent_id", "content_type", "chunk_index", "source_text", "span_start", "span_end")
    first = Window.partitionBy("parent_id").orderBy("content_type", "chunk_index")
    found = found.withColumn("__r", F.row_number().over(first)).filter("__r = 1")
    rows = found.join(messages.select("id", "session_id", "project_slug", "sequence", "ts"), found.parent_id == F.col("id"))
    rows = rows.orderBy(F.col("ts").desc_nulls_last(), F.col("id").asc()).limit(limit)
    columns = [F.col("source_text").alias("matched_text"), "span_start", "span_end", F.lit(1.0).alias("score"), F.lit("full_text_chunk").alias("source")]
    return rows.select("id", "session_id", "project_slug", "sequence", "ts", *columns)


def semantic_leg(messages: DataFrame, vectors: DataFrame, query_vector: Sequence[float], options: TranscriptSearchOptions, limit: int) -> DataFrame:
    """Messages by the cosine of their best chunk."""
    best = vector_search(vectors, query_vector, limit, options.content_types)
    hits = best.select("parent_id", F.col("source_text").alias("matched_text"), "span_start", "span_end", "score", F.lit("semantic").alias("source"))
    own = messages.select("id", "session_id", "project_slug", "sequence", "ts")
    found = own.join(F.broadcast(hits), F.col("id") == F.col("parent_id")).drop("parent_id")  # hits are cut to limit
    return found.select(*own.columns, "matched_text", "span_start", "span_end", "score", "source")


def with_content(found: DataFrame, messages: DataFrame) -> DataFrame:
    """found (a leg, or legs merged: few rows) with the readable content of its messages."""
    own = messages.select(F.col("id").alias("__id"), text.display(F.col("content")).alias("content"))
    return own.join(F.broadcast(found), F.col("__id") == F.col("id")).select(*found.columns[:5], "content", *found.columns[5:])


def merged(legs: Sequence[DataFrame], limit: int) -> DataFrame:
    """Legs one after another, the first row of each message kept, cut to limit. position numbers what is left."""
    rows = None
    for k, leg in enumerate(legs):
        order = Window.orderBy(F.col("score").desc(), F.col("ts").desc_nulls_last(), F.col("session_id").asc(), F.col("sequence").asc())
        leg = leg.withColumns({"__leg": F.lit(k), "__rank": F.row_number().over(order)})  # a leg is cut to its limit
        rows = leg if rows is None else rows.unionByName(leg)
    once = Window.partitionBy("session_id", "sequence").orderBy("__leg", "__rank")
    kept = rows.withColumn("__r", F.row_number().over(once)).filter("__r = 1")
    kept = kept.orderBy("__leg", "__rank").limit(limit)
    return kept.withColumn("position", F.row_number().over(Window.orderBy("__leg", "__rank"))).drop("__leg", "__rank", "__r")


def full_text(messages: DataFrame, vectors: DataFrame | None, options: TranscriptSearchOptions, limit: int = 10, user_id: str = "", sessions: DataFrame | None = None, case_insensitive: bool = False) -> DataFrame:
    """Messages whose text, then messages one of whose chunks holds the query; position gives their order."""
    rows = _scoped(messages, user_id, options, sessions)
    return with_content(merged(_text_legs(rows, vectors, options, limit, case_insensitive), limit), rows)


def _text_legs(rows: DataFrame, vectors: DataFrame | None, options: TranscriptSearchOptions, limit: int, case_insensitive: bool = False) -> list[DataFrame]:
    legs = [transcript_leg(rows, options, limit, case_insensitive)]
    if vectors is not None:
        legs.append(chunk_leg(rows, vectors, options, limit, case_insensitive))
    return legs


def semantic(messages: DataFrame, vectors: DataFrame, query_vector: Sequence[float], options: TranscriptSearchOptions, limit: int = 10, user_id: str = "", sessions: DataFrame | None = None) -> DataFrame:
    """Messages by the cosine of their best chunk; filters come before the ranking."""
    rows = _scoped(messages, user_id, options, sessions)
    own = f.on_vectors(vectors, user_id, options.filters, messages, sessions)
    found = with_content(semantic_leg(rows, own, query_vector, options, limit), rows)
    return found.orderBy(F.col("score").desc(), F.col("session_id").asc(), F.col("sequence").asc())


def hybrid(messages: DataFrame, vectors: DataFrame, query_vector: Sequence[float], options: TranscriptSearchOptions, limit: int = 10, user_id: str = "", sessions: DataFrame | None = None) -> DataFrame:
    """Both searches at three times the limit, merged text first, and re-ranked for diversity.

    Up to limit candidates stay in merged order. Messages without a vector count as zero vectors. Only ids, places and
    scores go through the legs; vectors and contents are fetched for the candidates alone.
    """
    if not 0 <= options.mmr_lambda <= 1:
        raise InvalidValue("lambda must be within 0 and 1", value=options.mmr_lambda)
    wide = 3 * limit
    rows = _scoped(messages, user_id, options, sessions)
    own = f.on_vectors(vectors, user_id, options.filters, messages, sessions)
    words = merged(_text_legs(rows, own, options, wide), wide).drop("position")
    candidates = merged([words, semantic_leg(rows, own, query_vector, options, wide)], 2 * wide)
    there = own.filter("vector IS NOT NULL").select("parent_id", "chunk_index", "content_type", "vector")
    there = there.join(F.broadcast(candidates.select(F.col("id").alias("parent_id"))), "parent_id", "left_semi")
    first = Window.partitionBy("parent_id").orderBy(F.col("chunk_index").asc(), F.col("content_type").asc())
    one = there.withColumn("__r", F.row_number().over(first)).filter("__r = 1").select("parent_id", F.col("vector").cast("array<double>"))
    ranked = candidates.join(one, candidates.id == one.parent_id, "left").drop("parent_id")
    ranked = ranked.withColumns({"query_id": F.lit(0), "query": F.lit([float(x) for x in query_vector]).cast("array<double>")})
    keep = tuple(c for c in candidates.columns if c != "position")
    return with_content(rerank(ranked, limit, options.mmr_lambda, keep).drop("query_id"), rows).orderBy("mmr_rank")


def search_transcripts(messages: DataFrame, vectors: DataFrame | None, options: TranscriptSearchOptions, embed: Callable[[str], Sequence[float]] | None = None, limit: int = 10, user_id: str = "", sessions: DataFrame | None = None) -> DataFrame:
    """Dispatch by search_type. Without vectors or a way to embed the query, everything is full text."""
    if options.search_type not in ("full_text", "semantic", "hybrid"):
        raise InvalidValue(f"unknown search type: {options.search_type}", search_type=options.search_type)
    if options.search_type == "full_text" or vectors is None or embed is None:
        return full_text(messages, vectors, options, limit, user_id, sessions)
    run = semantic if options.search_type == "semantic" else hybrid
    return run(messages, vectors, embed(options.query), options, limit, user_id, sessions)
