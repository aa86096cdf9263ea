"""Settings, from arguments or TIDEMARK_* variables, and the Spark settings that go with them."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

SPARK_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


@dataclass(frozen=True)
class Config:
    base_path: str = "tidemark-data"
    buckets: int = 64
    dimensions: int = 64
    embed_token_limit: int = 8192
    chunk_target: int = 1024
    chunk_overlap: int = 128
    chunk_min: int = 64
    batch_size: int = 16
    max_event_bytes: int = 400 * 1024
    max_content_bytes: int = 1_800_000
    reuse_vectors: bool = False
    token_ranks: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> Config:
        env = dict(os.environ if env is None else env)
        found = {f.name: env[f"TIDEMARK_{f.name.upper()}"] for f in fields(cls) if f"TIDEMARK_{f.name.upper()}" in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        read = {str: str, int: int, bool: lambda v: v.strip().lower() in ("1", "true", "yes", "on")}
        return cls(**{k: read[kinds[k]](v) for k, v in found.items()})


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    return builder.config(map={**SPARK_CONF, **conf}).getOrCreate()
