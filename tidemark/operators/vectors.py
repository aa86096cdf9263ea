"""Vector search: exact cosine top-k with the best chunk of each parent."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_by_norms, cosine_to, norm


def with_context(vectors: DataFrame, messages: DataFrame) -> DataFrame:
    """Vectors with the message they stem from; vectors without one are left out."""
    own = messages.select(F.col("id").alias("parent_id"), *(c for c in messages.columns if c not in vectors.columns and c != "id"))
    return vectors.join(own, "parent_id")


def best_per_parent(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The best chunk of each parent, ties to the least id."""
    w = Window.partitionBy(*by, "parent_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return scored.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def nearest(vectors: DataFrame, query: Sequence[float], k: int = 10) -> DataFrame:
    """The k vectors nearest to one query, ties to the least id."""
    scored = vectors.filter(F.col("vector").isNotNull()).withColumn("score", cosine_to(F.col("vector"), query))
    return scored.filter("score IS NOT NULL").orderBy(F.col("score").desc(), F.col("id").asc()).limit(k)


def vector_search(vectors: DataFrame, query: Sequence[float], k: int = 10, content_types: Sequence[str] | None = None) -> DataFrame:
    """The k parents nearest to one query: filter, score, best chunk of each, then the top. No content type
    stands for all of them."""
    rows = vectors.filter(F.col("vector").isNotNull())
    if content_types:
        rows = rows.filter(F.col("content_type").isin(list(content_types)))
    scored = rows.withColumn("score", cosine_to(F.col("vector"), query)).filter("score IS NOT NULL")
    return best_per_parent(scored).orderBy(F.col("score").desc(), F.col("parent_id").asc()).limit(k)


def vector_search_many(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest parents for every row of queries (query_id, query): one pass for all of them."""
    rows = vectors.filter(F.col("vector").isNotNull()).withColumn("__n", norm(F.col("vector")))
    pairs = rows.crossJoin(queries.withColumn("__q", norm(F.col("query"))))
    score = cosine_by_norms(F.col("vector"), F.col("query"), F.col("__n"), F.col("__q"))
    scored = pairs.withColumn("score", score).filter("score IS NOT NULL").drop("query", "__n", "__q")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("parent_id").asc())
    return best_per_parent(scored, ("query_id",)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def approximate_join(vectors: DataFrame, queries: DataFrame, k: int = 10, bucket_length: float = 0.5, tables: int = 6) -> DataFrame:
    """Candidates by locality-sensitive hashing, ranked by cosine: not exact, for large tables.

    Vectors are normalised, so Euclidean distance ranks like cosine. Ids without a common bucket don't appear, nor do
    vectors of another dimension than the queries'.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    size = queries.select(F.size("query")).first()
    d = size[0] if size else 1

    def unit(c: str):
        v = F.when(F.size(c) == d, F.col(c).cast("array<double>")).otherwise(F.array_repeat(F.lit(0.0), d))  # it may see rows before filters do
        n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return array_to_vector(F.transform(v, lambda x: x / F.when(n > 0, n).otherwise(1.0)))

    a = vectors.filter(f"size(vector) = {d} AND exists(vector, x -> x <> 0)").select("id", "parent_id", unit("vector").alias("features"))
    b = queries.filter("exists(query, x -> x <> 0)").select("query_id", unit("query").alias("features"))
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket_length, numHashTables=tables, seed=1).fit(a)
    pairs = model.approxSimilarityJoin(a, b, 1.42, distCol="d").select("datasetA.id", "datasetA.parent_id", "datasetB.query_id", (1 - F.col("d") * F.col("d") / 2).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id").asc())
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
