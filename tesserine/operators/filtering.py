"""Filter decisions: variance guard, threshold relaxation and the hybrid score, per query."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.numbers import rounded
from tesserine.operators import ordered
from tesserine.plans.staging import staged


def guarded(rows: DataFrame, query: str, key: str, threshold: int = 3, min_survivors: int = 8, bypass: float = 0.15, alpha: float = 0.3) -> DataFrame:
    """Survivors of each query with lane, hybrid and rank.

    rows: query, key, retriever_score, filter_score (0 to 4). Where the filter scores hardly
    vary (sample deviation under ``bypass``; one row has none), all rows stay in retriever
    order. Otherwise rows at the threshold stay, relaxed to 2 and then 1 while fewer than
    ``min_survivors`` do; if they are too few even then, the best 2 * min_survivors by retriever score stay.

    The level of a query is one aggregated row, and ranks are numbered in parts, so no task holds a query.
    """
    rows = staged(rows.select(query, key, "retriever_score", "filter_score"), "scored")
    reached = lambda t: F.count_if(F.col("filter_score") >= t) >= min_survivors
    at = F.when(reached(threshold), threshold).when(reached(2), 2).when(reached(1), 1)
    levels = rows.groupBy(query).agg(at.cast("int").alias("at"), (F.coalesce(F.stddev_samp("filter_score"), F.lit(0.0)) < bypass).alias("guard"))
    rated = ordered.with_few(rows, levels, [query])
    best = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("retriever_score"), key))
    few = rated.where("NOT guard AND at IS NULL").withColumn("place", best).where(F.col("place") <= 2 * min_survivors).drop("place")
    kept = rated.where("guard OR filter_score >= at").unionByName(few)
    lane = F.when(F.col("guard"), F.lit("guard")).when(F.col("at").isNull(), F.lit("retriever")).otherwise(F.concat(F.lit("at_"), F.col("at").cast("string")))
    share = (F.lit(Decimal(str(alpha))) * F.col("filter_score")).cast("double") / 4  # 0.3 * 3 is 0.9, which it isn't in doubles
    hybrid = rounded(F.when(F.col("guard"), F.col("retriever_score")).otherwise(F.col("retriever_score") + share), 6)
    out = kept.select(query, key, lane.alias("lane"), hybrid.alias("hybrid"))
    return ordered.numbered(out, [query], [F.desc("hybrid"), key], "rank").withColumn("rank", F.col("rank").cast("int"))


def fallback_scores(rows: DataFrame, query: str, order: list[str], score: str = "score") -> DataFrame:
    """The rows with the score of a reranker that isn't there: 1 for the first of each query, falling evenly by place."""
    placed = ordered.numbered(rows, [query], order, "__place")
    counts = placed.groupBy(query).agg(F.max("__place").alias("__n"))
    return ordered.with_few(placed, counts, [query]).withColumn(score, F.round(1 - (F.col("__place") - 1) / F.col("__n"), 9)).drop("__place", "__n")
