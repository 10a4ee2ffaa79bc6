"""Numbers, running sums and neighbours of rows in the order of their group, for groups of any size.

A window over a group holds the group in one task. Here the rows are range-partitioned by
group and order into parts, which are written; each part is a window of its own, and what a
group's earlier parts add up to is carried on. A part has one group at most that began in an
earlier part, so what is carried is one row a part, whatever the number of rows and groups.

Rows equal in group and order share a part: an order that ends with a key has no such rows. A
null group is a group of its own. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.plans.staging import staged

PART = "__part"


def in_parts(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows with the number of their part, written, so that every reader sees the same parts."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(rows.repartitionByRange(n, *groups, *order).withColumn(PART, F.spark_partition_id()), "ordered")


def with_few(rows: DataFrame, few: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    """Left join by keys, nulls equal. ``small`` is for a table of proven size: it is broadcast."""
    few = few.select(*[F.col(k).alias(f"__key_{k}") for k in keys], *[c for c in few.columns if c not in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return rows.join(F.broadcast(few) if small else few, same, "left").drop(*[f"__key_{k}" for k in keys])


def running(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], sums: Mapping[str, Column], at_most: Mapping[str, int] | None = None, through: bool = False) -> DataFrame:
    """The rows with, under each name of ``sums``, the sum over the rows before in their group; ``through`` adds the row itself.

    A sum over no value is null. at_most: limits of sums without negative values; rows whose
    sum passes a limit are left out, and parts behind it aren't shuffled again.
    """
    added = {name: f"__add_{name}" for name in sums}
    stored = in_parts(rows.withColumns({added[name]: c for name, c in sums.items()}).drop(*sums), groups, order)
    totals = stored.groupBy(*groups, PART).agg(*[F.sum(a).alias(a) for a in added.values()])
    by_part = Window.partitionBy(*groups).orderBy(PART)
    earlier = by_part.rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*groups, PART, F.lag(PART).over(by_part).alias("__earlier"), *[F.sum(a).over(earlier).alias(f"__carried_{n}") for n, a in added.items()])
    out = with_few(stored, carried.where("__earlier IS NOT NULL").drop("__earlier"), [*groups, PART], small=True)
    limits = dict(at_most or {})
    for name, most in limits.items():
        out = out.where(F.coalesce(F.col(f"__carried_{name}") <= most, F.lit(True)))
    within = Window.partitionBy(*groups, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if through else -1)
    out = out.withColumns({n: F.sum(a).over(within) for n, a in added.items()})
    out = out.withColumns({n: F.coalesce(F.col(n) + F.col(f"__carried_{n}"), F.col(n), F.col(f"__carried_{n}")) for n in added})
    for name, most in limits.items():
        out = out.where(F.coalesce(F.col(name) <= most, F.lit(True)))
    return out.drop(PART, *added.values(), *[f"__carried_{n}" for n in added])


def numbered(rows: DataFrame, groups: Sequence[str], order: Sequence[str | Column], name: str) -> DataFrame:
    """The rows with their number from 1 in their group."""
    return running(rows, groups, order, {name: F.lit(1)}, through=True)


def beside(rows: DataFrame, groups: Sequence[str], order: Sequence[str], value: str, before: str, after: str) -> DataFrame:
    """The rows with the value of the row before and after in their group; ties of the order by value."""
    place = [*order, value]
    stored = in_parts(rows.drop(before, after), groups, place)
    ends = stored.groupBy(*groups, PART).agg(F.min_by(value, F.struct(*place)).alias("__first"), F.max_by(value, F.struct(*place)).alias("__last"))
    by_part = Window.partitionBy(*groups).orderBy(PART)
    edges = ends.select(*groups, PART, F.lag("__last").over(by_part).alias("__left"), F.lead("__first").over(by_part).alias("__right"), F.count("*").over(Window.partitionBy(*groups)).alias("__n"))
    out = with_few(stored, edges.where("__n > 1").drop("__n"), [*groups, PART], small=True)  # two rows a part at most
    within = Window.partitionBy(*groups, PART).orderBy(*place)
    first, last = F.lag(F.lit(True)).over(within).isNull(), F.lead(F.lit(True)).over(within).isNull()
    out = out.withColumn(before, F.when(first, F.col("__left")).otherwise(F.lag(value).over(within)))
    return out.withColumn(after, F.when(last, F.col("__right")).otherwise(F.lead(value).over(within))).drop(PART, "__left", "__right")
