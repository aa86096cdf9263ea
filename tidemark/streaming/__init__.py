"""Structured Streaming: windows over events and incremental ingestion."""
