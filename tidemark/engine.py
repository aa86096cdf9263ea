"""The engine: one object over a store, with a method for everything that can be asked of sessions."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import Config
from .errors import InvalidSession
from .functions import filters as f
from .functions.chunking import Chunker, Limits
from .functions.counting import TokenCounter, default_counter
from .functions.filters import SearchFilters
from .operators import context, embed, events, search, sessions, upsert, vectors
from .schemas import SESSIONS, TABLES
from .sources.store import Store


class Engine:
    """Reads give lazy DataFrames; writes run at once. Use it as a context manager or call close()."""

    def __init__(self, spark: SparkSession, config: Config = Config(), provider: embed.Provider | None = None, counter: TokenCounter | None = None):
        self.spark, self.config, self.provider = spark, config, provider
        self.store = Store(spark, config.base_path, config.buckets)
        self.counter = counter or default_counter(config.token_ranks)
        self.chunker = Chunker(self.counter, Limits(config.embed_token_limit, config.chunk_target, config.chunk_overlap, config.chunk_min))

    def __enter__(self) -> Engine:
        self.initialize()
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def initialize(self) -> None:
        self.store.views()

    def close(self) -> None:
        for name in (*TABLES, "transcript_messages", "vectors_with_context", "schema_meta"):
            self.spark.catalog.dropTempView(name)

    # -- reading ----------------------------------------------------------------------------------------------

    def _messages(self, session_id: str | None = None) -> DataFrame:
        return self.store.read("transcripts", session_id)

    def _vectors(self) -> DataFrame:
        return self.store.read("transcript_vectors")

    def get_session_metadata(self, user_id: str, session_id: str) -> DataFrame:
        return sessions.get_session(self.store.read("sessions", session_id), user_id, session_id)

    def get_transcript_lines(self, user_id: str, project_slug: str | None, session_id: str, after_sequence: int | None = None) -> DataFrame:
        return context.lines(self._messages(session_id), user_id, session_id, project_slug, after_sequence)

    def get_event_lines(self, user_id: str, project_slug: str | None, session_id: str, after_sequence: int | None = None) -> DataFrame:
        return context.lines(self.store.read("events", session_id), user_id, session_id, project_slug, after_sequence).drop("data")

    def get_turn_context(self, user_id: str, session_id: str, turn: int, before: int = 2, after: int = 1, include_tool_outputs: bool = True) -> DataFrame:
        return context.turn_context(self._messages(session_id), session_id, turn, before, after, user_id, include_tool_outputs)

    def get_message_context(self, session_id: str, sequence: int, user_id: str = "", before: int = 5, after: int = 5, include_tool_outputs: bool = True) -> DataFrame:
        return context.message_context(self._messages(session_id), session_id, sequence, before, after, user_id, include_tool_outputs)

    def search_sessions(self, user_id: str = "", filters: SearchFilters = SearchFilters(), limit: int = 100) -> DataFrame:
        return sessions.search_sessions(self.store.read("sessions"), user_id, filters, limit)

    def search_transcripts(self, user_id: str, options: search.TranscriptSearchOptions, limit: int = 10) -> DataFrame:
        embed_query = (lambda q: self.provider.embed_batch([q])[0]) if self.provider else None
        return search.search_transcripts(self._messages(), self._vectors(), options, embed_query, limit, user_id, self.store.read("sessions"))

    def search_events(self, user_id: str = "", **wanted) -> DataFrame:
        return events.search_events(self.store.read("events"), user_id, **wanted)

    def list_event_types(self, user_id: str = "", session_id: str | None = None) -> DataFrame:
        return events.event_types(self.store.read("events", session_id), user_id, session_id)

    def supports_vector_search(self) -> bool:
        return self.provider is not None

    def vector_search(self, user_id: str, query_vector: Sequence[float], filters: SearchFilters = SearchFilters(), top_k: int = 100, vector_columns: Sequence[str] | None = None) -> DataFrame:
        own = f.on_vectors(self._vectors(), user_id, filters, self._messages(), self.store.read("sessions"))
        return vectors.vector_search(own, query_vector, top_k, vector_columns)

    def list_users(self, filters: SearchFilters = SearchFilters()) -> DataFrame:
        return sessions.list_users(self.store.read("sessions"), filters)

    def list_projects(self, user_id: str = "", filters: SearchFilters = SearchFilters()) -> DataFrame:
        return sessions.list_projects(self.store.read("sessions"), user_id, filters)

    def list_sessions(self, user_id: str = "", project_slug: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        return sessions.list_sessions(self.store.read("sessions"), user_id, project_slug, limit, offset)

    def get_active_sessions(self, user_id: str = "", project_slug: str | None = None, start_date=None, end_date=None, min_turn_count: int | None = None, limit: int = 100) -> DataFrame:
        return sessions.active_sessions(self.store.read("sessions"), self._messages(), user_id, project_slug, start_date, end_date, min_turn_count, limit)

    def get_session_statistics(self, user_id: str = "", filters: SearchFilters = SearchFilters()) -> DataFrame:
        scope = self.store.read("sessions").filter(f.every([f.of_user(user_id), f.on_sessions(filters)])).select("user_id", "session_id")
        inside = lambda t: self.store.read(t).join(scope, ["user_id", "session_id"], "left_semi")
        return sessions.session_statistics(self.store.read("sessions"), user_id, filters).unionByName(sessions.activity_statistics(inside("transcripts"), inside("events")))

    def get_session_sync_stats(self, user_id: str, project_slug: str | None, session_id: str) -> DataFrame:
        mine = f.every([f.of_user(user_id), f.equals("project_slug", project_slug)])
        return sessions.sync_stats(self._messages(session_id).filter(mine), self.store.read("events", session_id).filter(mine))

    def get_stored_transcript_ids(self, user_id: str, project_slug: str | None, session_id: str) -> DataFrame:
        return context.ids(self._messages(session_id).filter(f.every([f.equals("project_slug", project_slug)])), user_id, session_id)

    def get_stored_event_ids(self, user_id: str, project_slug: str | None, session_id: str) -> DataFrame:
        return context.ids(self.store.read("events", session_id).filter(f.every([f.equals("project_slug", project_slug)])), user_id, session_id)

    def find_missing_sequences(self, user_id: str, session_id: str, messages: int | None, event_count: int | None, event_base: int = 1) -> DataFrame:
        """(source, session_id, expected, n_missing, missing) for what should be stored; no count, no row."""
        out = None
        for source, table, count, base in (("transcripts", "transcripts", messages, 0), ("events", "events", event_count, event_base)):
            expected = self.spark.createDataFrame([(session_id, count)], "session_id string, expected int")
            rows = self.store.read(table, session_id).filter(f.every([f.of_user(user_id)]))
            gaps = context.sync_gaps(rows, expected, base).withColumn("source", F.lit(source))
            out = gaps if out is None else out.unionByName(gaps)
        return out

    # -- writing ----------------------------------------------------------------------------------------------

    def upsert_session_metadata(self, rows: DataFrame | Iterable[dict], order: str | None = None) -> None:
        """Of several rows of one session the last one holds: of dictionaries by their place, of a DataFrame by the
        column `order`, without which a session must not come twice."""
        if not isinstance(rows, DataFrame):
            listed = [{k: r.get(k) for k in SESSIONS.names} | {"__order": n} for n, r in enumerate(rows)]
            rows, order = self.spark.createDataFrame(listed, T.StructType([*SESSIONS.fields, T.StructField("__order", T.LongType())])), "__order"
        if rows.filter(F.col("session_id").isNull() | (F.col("session_id") == "")).limit(1).count():
            raise InvalidSession("session_id is missing", field="session_id")
        if order is None:
            if rows.groupBy(*upsert.SESSION_KEY).count().filter("count > 1").limit(1).count():
                raise InvalidSession("a session comes twice and no order is given", field="order")
            rows, order = rows.withColumn("__order", F.lit(0)), "__order"
        given = [c for c in SESSIONS.names if c in rows.columns]
        if "turn_count" not in given:
            rows, given = rows.withColumn("turn_count", F.lit(0)), [*given, "turn_count"]
        folded = upsert.upsert_sessions(None, rows.select(*given, F.col(order).alias("__order")), "__order").drop("__order")
        self.store.append("sessions", folded.withColumn("synced_at", F.current_timestamp()))

    def sync_transcript_lines(self, lines: DataFrame, order: str, start_sequence: int = 0, with_vectors: bool = True) -> DataFrame | None:
        """Stores lines (user_id, host_id, project_slug, session_id, role, content, turn, ts) in the given order.

        Messages are stored first; vectors follow if there is a provider, and its failures are rows with null
        vectors. Gives the outcome of embedding, if any was tried.
        """
        rows = upsert.numbered(lines, order, start_sequence, "msg").withColumn("synced_at", F.current_timestamp())
        rows = upsert.oversize_guard(rows, self.config.max_content_bytes)
        self.store.append("transcripts", rows)
        return self._embed(rows) if with_vectors and self.provider else None

    def sync_event_lines(self, lines: DataFrame, order: str, start_sequence: int = 0) -> None:
        rows = upsert.event_rows(upsert.numbered(lines, order, start_sequence, "evt"), max_bytes=self.config.max_event_bytes)
        self.store.append("events", rows.withColumn("synced_at", F.current_timestamp()))

    def _embed(self, messages: DataFrame) -> DataFrame:
        known = embed.known_vectors(self._vectors(), self.provider.model_name) if self.config.reuse_vectors else None
        found = embed.message_vectors(messages, self.provider, self.chunker, known, self.config.batch_size)
        version = self.store.append("transcript_vectors", found.withColumn("created_at", F.current_timestamp()))
        return embed.outcome(self.store.written("transcript_vectors", version))

    def upsert_embeddings(self, rows: DataFrame, model: str) -> None:
        """Vectors (parent_id, user_id, session_id, project_slug, vector) that replace all others of their parents."""
        self.store.append("transcript_vectors", upsert.precomputed_vectors(rows.withColumns({"content_type": F.lit("user_query"), "source_text": F.lit("")}), model))

    def store_vectors(self, rows: DataFrame, model: str) -> None:
        """Precomputed vectors by content type; they replace all others of their parents."""
        self.store.append("transcript_vectors", upsert.precomputed_vectors(rows, model))

    # -- upkeep -----------------------------------------------------------------------------------------------

    def delete_session(self, user_id: str, project_slug: str | None, session_id: str) -> bool:
        """Whether the session was there; one of another project stays."""
        found = self.store.read("sessions", session_id).filter(f.every([f.of_user(user_id), f.equals("project_slug", project_slug)])).select("user_id", "session_id")
        gone = [tuple(r) for r in found.collect()]
        if gone:
            self.store.delete(self.spark.createDataFrame(gone, "user_id string, session_id string"))
        return bool(gone)

    def backfill_embeddings(
        self, user_id: str, project_slug: str | None = None, session_id: str | None = None, *,
        batch_size: int = 10_000, on_progress: Callable[[int, int], None] | None = None,
    ) -> embed.Outcome:
        """Embeds messages that lack vectors, in order and in batches, each of which is stored before the next.

        on_progress gets how many are done and how many there are after each batch. A batch that fails counts as failed
        and the next goes on; the first 50 errors are told.
        """
        mine = f.every([f.of_user(user_id), f.equals("project_slug", project_slug)])
        missing = upsert.unembedded(self._messages(session_id).filter(mine), self._vectors())
        todo = [tuple(r) for r in missing.select("user_id", "session_id", "sequence").collect()]
        out = embed.Outcome(found=len(todo))
        for start in range(0, len(todo), batch_size):
            part = todo[start : start + batch_size]
            keys = F.broadcast(self.spark.createDataFrame(part, "__u string, __s string, __n int"))
            same = F.col("user_id").eqNullSafe(F.col("__u")) & (F.col("session_id") == F.col("__s")) & (F.col("sequence") == F.col("__n"))
            try:
                done = self._embed(self._messages(session_id).join(keys, same, "left_semi")).first()
                out.stored, out.failed = out.stored + done.stored, out.failed + done.failed
            except Exception as e:
                out.failed += len(part)
                if len(out.errors) < 50:
                    out.errors.append(f"batch {start // batch_size + 1}: {e}")
            if on_progress:
                on_progress(start + len(part), len(todo))
        return out

    def rebuild_vectors(self, user_id: str, project_slug: str | None, session_id: str) -> DataFrame:
        return self._embed(self._messages(session_id).filter(f.every([f.of_user(user_id), f.equals("project_slug", project_slug)])))

    def compact(self, vacuum: bool = False) -> None:
        """Folds every table's log into its base; vacuum deletes what is folded, once no reader needs it."""
        for table in TABLES:
            self.store.compact(table)
            if vacuum:
                self.store.vacuum(table)
