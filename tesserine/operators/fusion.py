"""Fusion and shaping of ranked lists: reciprocal ranks, boosts, per-file caps, top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rrf(lists: list[DataFrame], key: str, k: int = 60) -> DataFrame:
    """(key, score, first_list, first_rank) from lists with key and rank: the sum of 1 / (k + rank)."""
    union = None
    for number, hits in enumerate(lists):
        part = hits.select(F.col(key), F.lit(number).alias("list"), F.col("rank"))
        union = part if union is None else union.unionByName(part)
    first = F.min(F.struct("list", "rank"))
    return union.groupBy(key).agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score"), first.alias("f")).select(key, "score", F.col("f.list").alias("first_list"), F.col("f.rank").alias("first_rank"))


def symbol_boosts(hits: DataFrame, identifiers: list[str], file_hints: list[str]) -> DataFrame:
    """Candidate hits with symbol, role and path boosts added to their score.

    hits: score, primary_symbol, all_symbols (array), all_roles (array), rel_path and any other
    columns. +0.25 primary symbol asked for, +0.15 any symbol asked for, +0.10 role complete,
    else +0.05 declaration, +0.10 a hint in the path, -0.05 role mixed where the candidates hold
    a complete chunk of the same primary symbol.
    """
    wanted, hints = sorted({i for i in identifiers or [] if i}), sorted({h.lower() for h in file_hints or [] if h})
    symbol = F.coalesce(F.col("primary_symbol"), F.lit(""))
    role = lambda name: F.coalesce(F.array_contains("all_roles", name), F.lit(False))
    asked = F.array(*[F.lit(i) for i in wanted]).cast("array<string>")
    path = F.lower(F.coalesce(F.col("rel_path"), F.lit("")))
    hinted = F.lit(False)
    for h in hints:
        hinted = hinted | F.contains(path, F.lit(h))
    rank = F.when(role("complete"), 2).when(role("declaration"), 1).otherwise(0)
    best = hits.where(symbol != "").groupBy(F.col("primary_symbol").alias("best_symbol")).agg(F.max(rank).alias("best_rank"))
    joined = hits.join(best, hits.primary_symbol == best.best_symbol, "left")
    add = lambda condition, amount: F.when(condition, amount).otherwise(0.0)
    boost = add((symbol != "") & symbol.isin(*wanted), 0.25) + add(F.coalesce(F.arrays_overlap(asked, F.array_compact("all_symbols")), F.lit(False)), 0.15)
    boost = boost + F.when(role("complete"), 0.10).when(role("declaration"), 0.05).otherwise(0.0) + add(hinted, 0.10) - add(role("mixed") & (F.col("best_rank") >= 2), 0.05)
    return joined.withColumn("score", F.col("score") + boost).select(*hits.columns)


def diversify(hits: DataFrame, group: str, key: str, most: int = 3) -> DataFrame:
    """At most ``most`` rows a group by score; a null group is a group of its own."""
    order = Window.partitionBy(F.coalesce(F.col(group), F.lit(""))).orderBy(F.desc("score"), key)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")


def top(hits: DataFrame, k: int, *ties: str) -> DataFrame:
    return hits.orderBy(F.desc("score"), *ties).limit(k)
