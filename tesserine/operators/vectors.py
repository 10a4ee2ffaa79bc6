"""Exact vector search: cosine on unit vectors, filters before the ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    """x / |x|; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def knn(vectors: DataFrame, query: Sequence[float], k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, score, rank): the k best by rounded product, ties to the smaller id. The query is one literal vector."""
    scored = vectors.select(vec_id, F.round(dot(F.col(embedding), F.array(*[F.lit(float(x)) for x in query])), 6).alias("score"))
    return ranked(scored.orderBy(F.desc("score"), vec_id).limit(k), vec_id)


def ranked(hits: DataFrame, key: str) -> DataFrame:
    """A short hit list with its rank from 1."""
    from pyspark.sql import Window

    return hits.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), key)))
