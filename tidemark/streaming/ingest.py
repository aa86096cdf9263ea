"""Continuous ingestion: micro-batches go through the same upserts as batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def into(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, trigger: str = "1 minute") -> StreamingQuery:
    """Runs sink on every micro-batch. Sinks are upserts by key, so a batch that runs again changes nothing."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()
