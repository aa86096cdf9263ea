"""Diversity re-ranking (R9): relevance against the mean similarity to what has been taken already."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..errors import InvalidValue


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def mmr(vectors: Sequence[Sequence[float]], query: Sequence[float], k: int, lambda_: float = 0.7) -> list[int]:
    """Places of the k picks, in order. With k or fewer vectors they stay as they are. Ties go to the first.

    Sums of similarities to the picks are kept up, so a round costs one product with the last pick.
    """
    if not 0 <= lambda_ <= 1:
        raise InvalidValue("lambda must be within 0 and 1", value=lambda_)
    if not len(vectors):
        return []
    if len({len(v) for v in vectors} | {len(query)}) != 1:
        raise InvalidValue("all vectors must have the query's dimension", dimension=len(query))
    if k <= 0:
        return []
    if k >= len(vectors):
        return list(range(len(vectors)))
    x, q = _unit(np.asarray(vectors, float)), _unit(np.asarray(query, float))
    relevance, alike, free, picks = x @ q, np.zeros(len(x)), np.ones(len(x), bool), []
    for _ in range(k):
        novelty = 1 - alike / len(picks) if picks else 1.0
        score = np.where(free, lambda_ * relevance + (1 - lambda_) * novelty, -np.inf)
        best = int(score.argmax())
        picks.append(best)
        free[best] = False
        alike += x @ x[best]
    return picks


def rerank(candidates: DataFrame, k: int, lambda_: float = 0.7, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """For every query_id, the k candidates picked: columns query_id, keep and mmr_rank (from 1).

    candidates has (query_id, position, vector, query, keep...). A null vector counts as zeros. Groups are bounded
    by the candidates taken for a query, not by the corpus.
    """
    if not 0 <= lambda_ <= 1:
        raise InvalidValue("lambda must be within 0 and 1", value=lambda_)
    kinds = dict(candidates.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in ("query_id", *keep)) + ", mmr_rank int"

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position").reset_index(drop=True)
        query = list(rows["query"].iloc[0])
        vectors = [[0.0] * len(query) if v is None else list(v) for v in rows["vector"]]
        picks = mmr(vectors, query, k, lambda_)
        out = rows.loc[picks, ["query_id", *keep]].copy()
        out["mmr_rank"] = np.arange(1, len(picks) + 1, dtype=np.int32)
        return out

    return candidates.groupBy("query_id").applyInPandas(run, schema)
