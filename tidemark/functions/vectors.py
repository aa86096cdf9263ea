"""Cosine similarity as a column, in double precision."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: Sequence[float]) -> Column:
    return F.lit([float(x) for x in v]).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either is a zero vector; null where either is null or their dimensions differ."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_by_norms(a: Column, b: Column, norm_a: Column, norm_b: Column) -> Column:
    """cosine of columns whose norms are there already, so that each pair costs one product."""
    norms = norm_a * norm_b
    return F.when(F.size(a) != F.size(b), F.lit(None).cast("double")).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def cosine_to(column: Column, query: Sequence[float]) -> Column:
    """cosine of a column of arrays with one query, a matrix product for each Arrow batch."""
    q = np.asarray(query, float)
    length = float(np.sqrt(q @ q))

    @F.arrow_udf("double")
    def run(vectors: pa.Array) -> pa.Array:
        size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
        values = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False)  # null numbers are NaN
        rows = np.flatnonzero(size == len(q))
        starts = (np.cumsum(np.maximum(size, 0)) - size)[rows]
        x = values[starts[:, None] + np.arange(len(q))] if len(q) else np.zeros((len(rows), 0))
        norms = np.sqrt(np.einsum("ij,ij->i", x, x)) * length
        out = np.full(len(size), np.nan)
        out[rows] = np.where(norms == 0, 0.0, (x @ q) / np.where(norms == 0, 1.0, norms))
        return pa.array(out, mask=np.isnan(out))

    return run(column)
