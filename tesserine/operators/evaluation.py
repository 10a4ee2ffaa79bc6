"""Two rankings measured against each other and against known answers; statistics of caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of ids: 1 for two empty ones."""
    return F.when((F.size(a) <= 0) & (F.size(b) <= 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def precision(ids: Column, relevant: Column, k: int) -> Column:
    """Share of the first k ids that are relevant, by the number that there are; 0 without any or without relevant ids."""
    first = F.slice(ids, 1, k)
    hits = F.size(F.filter(first, lambda x: F.array_contains(relevant, x)))
    return F.when((F.size(first) > 0) & (F.size(relevant) > 0), hits / F.size(first)).otherwise(F.lit(0.0))


def _lists(hits: DataFrame, k: int, out: str) -> DataFrame:
    rows = hits.where(F.col("rank") <= k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("l"))
    return rows.select("query", F.transform("l", lambda x: x["id"]).alias(out))


def compared(queries: DataFrame, a: DataFrame, b: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query, overlap, precision_a, precision_b) of every query.

    a, b: query, id, rank; relevant: query, id. At most k ids of a query are gathered from a
    ranking, and its relevant ids.
    """
    known = relevant.groupBy("query").agg(F.collect_set("id").alias("relevant"))
    kind = relevant.schema["id"].dataType.simpleString()
    none = F.array().cast(f"array<{kind}>")
    rows = queries.select("query").distinct().join(_lists(a, k, "a"), "query", "left").join(_lists(b, k, "b"), "query", "left").join(known, "query", "left")
    a_, b_, r = (F.coalesce(F.col(c), none) for c in ("a", "b", "relevant"))
    return rows.select("query", F.round(overlap(a_, b_), 9).alias("overlap"), F.round(precision(a_, r, k), 9).alias("precision_a"), F.round(precision(b_, r, k), 9).alias("precision_b"))


def averages(measured: DataFrame) -> DataFrame:
    """One row: the number of queries, the means over all of them and the gain of b over a."""
    means = measured.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("overlap", "precision_a", "precision_b")])
    return means.select("n", *[F.round(c, 6).alias(c) for c in ("overlap", "precision_a", "precision_b")], F.round(F.col("precision_b") - F.col("precision_a"), 6).alias("gain"))


def best(measured: DataFrame, by: Column, most: int = 5) -> DataFrame:
    """The queries that rank highest by a measure, ties by query."""
    return measured.withColumn("measure", F.round(by, 9)).orderBy(F.desc("measure"), "query").limit(most)


def cache_stats(entries: DataFrame, file: str) -> DataFrame:
    """(entries, files) of a cache."""
    return entries.agg(F.count("*").alias("entries"), F.count_distinct(file).alias("files"))


def hit_stats(lookups: DataFrame, hit: str = "hit") -> DataFrame:
    """(hits, misses, hit_rate) of lookups; the rate as a text such as ``62.5%``."""
    row = lookups.agg(F.count_if(F.col(hit)).alias("hits"), F.count_if(~F.col(hit)).alias("misses"))
    return row.withColumn("hit_rate", F.format_string("%.1f%%", F.coalesce(F.try_divide(F.col("hits") * 100.0, F.col("hits") + F.col("misses")), F.lit(0.0))))
