"""Texts of messages and events as columns: extraction (E1-E6), display (R12, R13) and decoding for search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BLOCKS, CONTENT_TYPES

TOOL_CHARACTERS = 10_000


def _is_array(content: Column) -> Column:
    return F.coalesce(content.startswith("["), F.lit(False)) & F.from_json(content, BLOCKS).isNotNull()


def decoded(content: Column) -> Column:
    """A JSON string without its quotes and escapes; other content as it stands."""
    quoted = content.startswith('"') & content.endswith('"') & (F.length(content) > 1)
    return F.when(quoted, F.coalesce(F.get_json_object(F.concat(F.lit('{"s":'), content, F.lit("}")), "$.s"), content)).otherwise(content)


def _joined(blocks: Column, kind: str, between: str) -> Column:
    texts = F.transform(F.filter(blocks, lambda b: (b["type"] == kind) & b[kind].isNotNull() & (b[kind] != "")), lambda b: b[kind])
    return F.nullif(F.array_join(texts, between), F.lit(""))


def extracted(df: DataFrame, role: str = "role", content: str = "content") -> DataFrame:
    """Adds the up to four texts of each message that are embedded, null where there is none.

    Users give their text (the text blocks of a list), assistants text and thinking blocks joined by blank lines
    (or their whole text), tools their first 10,000 characters. Other roles give nothing.
    """
    raw, kind = F.col(content), F.col(role)
    blocks, is_blocks, text = F.from_json(raw, BLOCKS), _is_array(raw), F.nullif(decoded(raw), F.lit(""))
    return df.withColumns({
        "user_query": F.when(kind == "user", F.when(is_blocks, _joined(blocks, "text", "\n\n")).otherwise(text)),
        "assistant_response": F.when(kind == "assistant", F.when(is_blocks, _joined(blocks, "text", "\n\n")).otherwise(text)),
        "assistant_thinking": F.when((kind == "assistant") & is_blocks, _joined(blocks, "thinking", "\n\n")),
        "tool_output": F.when(kind == "tool", F.substring(text, 1, TOOL_CHARACTERS)),
    })


def unpivoted(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content_type, source_text): a row for each text that is there."""
    pairs = ", ".join(f"'{c}', {c}" for c in CONTENT_TYPES)
    return df.select(*keys, F.expr(f"stack({len(CONTENT_TYPES)}, {pairs}) AS (content_type, source_text)")).filter("source_text IS NOT NULL")


def content_type_counts(df: DataFrame) -> DataFrame:
    """How many messages have each of the four texts."""
    return df.agg(*(F.sum(F.when(F.col(c).isNotNull() & (F.col(c) != ""), 1).otherwise(0)).alias(c) for c in CONTENT_TYPES))


def searchable(content: Column) -> Column:
    """What full-text search looks at: decoded text, or the text and thinking of blocks."""
    blocks = F.from_json(content, BLOCKS)
    texts = F.transform(F.filter(blocks, lambda b: b["type"].isin("text", "thinking")), lambda b: F.coalesce(b["text"], b["thinking"]))
    return F.when(_is_array(content), F.array_join(texts, "\n")).otherwise(decoded(content))


def display(content: Column) -> Column:
    """Readable text of a message: blocks on lines of their own, tools and thinking marked."""
    blocks = F.from_json(content, BLOCKS)
    line = lambda b: (
        F.when((b["type"] == "text") & (b["text"] != ""), b["text"])
        .when((b["type"] == "thinking") & (b["thinking"] != ""), F.concat(F.lit("[thinking] "), b["thinking"]))
        .when(b["type"] == "tool_use", F.concat(F.lit("[tool_use: "), F.coalesce(b["name"], F.lit("unknown")), F.lit("]")))
        .when((b["type"] == "tool_result") & (b["content"] != "") & ~b["content"].startswith("[") & ~b["content"].startswith("{"), F.concat(F.lit("[tool_result] "), F.substring(b["content"], 1, 200)))
    )
    text = F.array_join(F.filter(F.transform(blocks, line), lambda x: x.isNotNull()), "\n")
    return F.when(content.isNull(), "").when(_is_array(content), F.when(text != "", text).otherwise(F.substring(content, 1, 500))).when(content.startswith("{"), F.substring(content, 1, 500)).otherwise(decoded(content))


def event_display(event: Column, data: Column, payload: str = "$.data") -> Column:
    """The event's type and what matters of its payload, set apart by bars."""
    at = lambda p: F.nullif(F.get_json_object(data, f"{payload}.{p}"), F.lit(""))
    named = lambda label, value: F.when(value.isNotNull(), F.concat(F.lit(label + "="), value))
    tool, llm = event.isin("tool:pre", "tool:post"), event.isin("llm:request", "llm:response")
    block, orchestrator, agent = event.startswith("content_block:"), event == "orchestrator:complete", event == "delegate:agent_completed"
    usage = F.when(at("usage").startswith("{"), F.concat(F.lit("tokens="), F.coalesce(at("usage.input"), F.lit("0")), F.lit("in/"), F.coalesce(at("usage.output"), F.lit("0")), F.lit("out")))
    total = F.when(at("total_blocks") != "0", at("total_blocks"))
    return F.concat_ws(
        " | ", F.coalesce(event, F.lit("")),
        F.when(tool, named("tool", at("tool_name"))),
        F.when(llm, named("model", at("model"))), F.when(llm, named("provider", at("provider"))), F.when(llm, usage),
        F.when(block, named("type", at("block_type"))), F.when(block & total.isNotNull(), named("block", F.concat(at("block_index"), F.lit("/"), total))),
        F.when(orchestrator, named("orchestrator", at("orchestrator"))), F.when(orchestrator, named("turns", at("turn_count"))),
        F.when(agent, named("agent", F.coalesce(at("agent"), at("agent_name")))),
    )


def sentences(text: Column) -> Column:
    """Sentences that end in a mark followed by blanks; blank ones are dropped (C4)."""
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s) != "")
