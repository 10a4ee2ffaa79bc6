"""A stored vector index of inverted lists: coarse centroids, lists on disk, few lists read a search.

Centroids are fitted on a bounded sample; every vector is then put into the list of its nearest
centroid, whole. Lists are numbered along the main axis of their centroids and dealt in that
order to shelves, the partitions of the table, so that lists near each other share a shelf.
Within a shelf rows are sorted by list: a search reads the shelves of its lists and, by the
statistics of row groups, little else. Scores are those of the stored vectors themselves, so
the only error of a search is a neighbour in a list that wasn't read; with all lists it has none.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.operators.vectors import dot, ranked

#: Rows and bytes of the sample that centroids are fitted on.
SAMPLE_ROWS, SAMPLE_BYTES = 65_536, 64 << 20
#: Lists at most: a centroid is held by every task.
LISTS = 65_536
SHELVES = 64
#: Rows of a list, and queries, that one task compares at once.
PIECE, BLOCK = 65_536, 1024
#: Queries at most that the number of lists to read is chosen by.
CALIBRATION = 256
#: Digits that scores are rounded to before they are ranked.
DIGITS = 6


def usable(embedding: Column, dim: int | None = None) -> Column:
    """Whether a vector can be indexed: not null or empty, without null or non-finite entries, and of the dimension."""
    sound = embedding.isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(sound & (F.size(embedding) == dim) if dim else sound, F.lit(False))


def centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's means from spread starting points; a mean without members moves to the point farthest from its own."""
    start = np.unique(sample, axis=0)
    lists = min(lists, len(start))
    means = start[np.linspace(0, len(start) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near, gap = _nearest(sample, means, 1)
        near, gap = near[:, 0], gap[:, 0].copy()
        count = np.bincount(near, minlength=lists)
        total = np.zeros_like(means)
        np.add.at(total, near, sample)
        means = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], means)
        for empty in np.flatnonzero(count == 0):
            far = int(np.argmax(gap))
            means[empty], gap[far] = sample[far], -1
    axis = np.linalg.svd(means - means.mean(axis=0), full_matrices=False)[2][0]
    return means[np.argsort(means @ axis, kind="stable")]


def _nearest(points: np.ndarray, means: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, squared distances) of the k nearest means of each point, nearest first."""
    k = min(k, len(means))
    square = (means**2).sum(axis=1)
    numbers, gaps = np.empty((len(points), k), np.int64), np.empty((len(points), k))
    step = max(1, (1 << 22) // len(means))
    for at in range(0, len(points), step):
        part = points[at : at + step]
        gap = square - 2 * part @ means.T + (part**2).sum(axis=1)[:, None]
        some = np.argpartition(gap, k - 1, axis=1)[:, :k] if k < len(means) else np.tile(np.arange(k), (len(part), 1))
        value = np.take_along_axis(gap, some, axis=1)
        order = np.argsort(value, axis=1, kind="stable")
        numbers[at : at + step], gaps[at : at + step] = np.take_along_axis(some, order, axis=1), np.take_along_axis(value, order, axis=1)
    return numbers, gaps


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build(vectors: DataFrame, path: str, key: str = "vec_id", embedding: str = "embedding", keep: Sequence[str] = (), lists: int | None = None, sample_rows: int = SAMPLE_ROWS) -> None:
    """Write the index below ``path``: every usable row, with the columns of ``keep`` to filter by.

    The dimension is the most frequent length of the vectors. ``lists`` is the square root of
    the rows unless given. The sample holds the ``sample_rows`` rows of least hash, fewer where
    they would pass SAMPLE_BYTES; no other step samples.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(F.col(embedding))).select(F.col(key).alias("key"), F.transform(embedding, lambda x: x.cast("double")).alias("vector"), *keep)
    head = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    dim, n = (head.dim, head.n) if head else (0, 0)
    rows = rows.where(F.size("vector") == dim)
    lists = max(1, min(lists or math.isqrt(n), LISTS))
    drawn = rows.orderBy(F.xxhash64("key", "vector"), "key").limit(min(sample_rows, max(lists, SAMPLE_BYTES // (8 * max(dim, 1))))).select("vector").toArrow()
    means = centroids(_matrix(drawn.column("vector")), lists) if n else np.zeros((0, 0))
    spark.createDataFrame([(i, m) for i, m in enumerate(means.tolist())], "list int, mean array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    names = [*rows.columns, "list"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", list int"

    def assign(batches):
        for batch in batches:
            near = _nearest(_matrix(batch.column("vector")), means, 1)[0][:, 0] if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], names)

    put = rows.mapInArrow(assign, schema).withColumn("shelf", F.expr(f"list * {SHELVES} div {max(1, len(means))}").cast("int"))
    # ranges end within a list where it is large, so a hot list takes several tasks and files
    put.repartitionByRange("shelf", "list", F.xxhash64("key")).sortWithinPartitions("shelf", "list").write.mode("overwrite").partitionBy("shelf").parquet(f"{path}/lists")


class VectorIndex:
    """A stored index. Scores are inner products, rounded; ties go to the smaller key."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        stored = spark.read.parquet(f"{path}/centroids").orderBy("list").toArrow()  # LISTS rows at most
        self.means = _matrix(stored.column("mean")) if len(stored) else np.zeros((0, 0))
        self.lists = spark.read.parquet(f"{path}/lists") if len(stored) else None

    def probed(self, query: Sequence[float], probes: int) -> list[int]:
        return _nearest(np.array([query], np.float64), self.means, probes)[0][0].tolist() if len(self.means) else []

    def rows(self, numbers: Sequence[int]) -> DataFrame:
        """The rows of some lists: partitions are pruned by shelf, row groups by list."""
        shelves = sorted({i * SHELVES // len(self.means) for i in numbers})
        return self.lists.where(F.col("shelf").isin(shelves) & F.col("list").isin(list(numbers)))

    def near(self, query: Sequence[float], k: int, probes: int = 8, where: Column | None = None) -> DataFrame:
        """(key, score, rank): the k best of the ``probes`` lists nearest to one query; ``where`` filters before the ranking. Expressions only."""
        if not len(self.means):
            return self.spark.createDataFrame([], "key long, score double, rank int")
        found = self.rows(self.probed(query, probes))
        found = found if where is None else found.where(where)
        score = F.round(dot(F.col("vector"), F.array(*[F.lit(float(x)) for x in query])), DIGITS)
        return ranked(found.select("key", score.alias("score")).orderBy(F.desc("score"), "key").limit(k), "key")

    def search(self, queries: DataFrame, k: int, probes: int = 8, where: Column | None = None, skip_self: bool = False) -> DataFrame:
        """(query_id, rank, key, score): the k best of each of many queries (query_id, vector).

        Queries go to the lists they probe, as rows go to their list, in pieces of a bounded
        number of rows and blocks of a bounded number of queries: a task compares one piece with
        one block and hands on the k best of each query. Queries that are null, of another
        dimension or not finite find nothing. ``skip_self`` leaves out rows of the query's id.
        """
        return self._search(queries, k, probes, where, skip_self).select("query_id", "rank", "key", "score")

    def calibrate(self, queries: DataFrame, k: int, target: float = 0.9) -> int:
        """The least number of lists that hold the share ``target`` of the k best of sample queries.

        The sample is at most CALIBRATION of the (query_id, vector) rows, by hash; their exact
        neighbours are found over all lists. How few lists do depends on how far the vectors cluster.
        """
        some = queries.where(usable(F.col("vector"), self.means.shape[1] if len(self.means) else None)).orderBy(F.xxhash64("query_id", "vector")).limit(CALIBRATION).select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector"))
        asked = some.toArrow()
        if not len(asked) or not len(self.means):
            return max(1, len(self.means))
        order = _nearest(_matrix(asked.column("vector")), self.means, len(self.means))[0]
        place = np.argsort(order, axis=1)
        row = {q: i for i, q in enumerate(asked.column("query_id").to_pylist())}
        found = self._search(some, k, len(self.means), None, False).select("query_id", "list").collect()  # CALIBRATION * k rows at most
        needed = np.sort([place[row[r.query_id], r.list] for r in found])
        return int(needed[max(0, math.ceil(target * len(needed)) - 1)]) + 1 if len(needed) else len(self.means)

    def _search(self, queries: DataFrame, k: int, probes: int, where: Column | None, skip_self: bool) -> DataFrame:
        kind, own = queries.schema["query_id"].dataType.simpleString(), self.lists.schema["key"].dataType.simpleString() if self.lists else "long"
        if not len(self.means):
            return queries.limit(0).selectExpr("query_id", "1 AS rank", f"CAST(NULL AS {own}) AS key", "0D AS score", "0 AS list")
        means, dim = self.means, self.means.shape[1]
        asked = queries.select("query_id", F.transform("vector", lambda x: x.cast("double")).alias("vector")).where(usable(F.col("vector"), dim))

        def route(batches):
            for batch in batches:
                near = _nearest(_matrix(batch.column("vector")), means, probes)[0] if len(batch) else np.zeros((0, 1), np.int64)
                at = pa.array(np.repeat(np.arange(len(batch)), near.shape[1]))
                yield pa.RecordBatch.from_arrays([*batch.take(at).columns, pa.array(near.ravel().astype(np.int32))], ["query_id", "vector", "list"])

        routed = asked.mapInArrow(route, f"query_id {kind}, vector array<double>, list int")
        found = self.lists if where is None else self.lists.where(where)
        pieces = found.groupBy("list").agg(F.ceil(F.count("*") / F.lit(PIECE)).alias("pieces"))
        blocks = routed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"))
        plan = pieces.join(blocks, "list")  # LISTS rows at most
        left = found.join(F.broadcast(plan), "list").withColumn("piece", F.pmod(F.xxhash64("key", "vector"), "pieces")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        right = routed.join(F.broadcast(plan), "list").withColumn("block", F.pmod(F.xxhash64("query_id", "vector"), "blocks")).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))

        def compare(rows: pa.Table, some: pa.Table) -> pa.Table:
            out = [[], [], []]
            if len(rows) and len(some):
                order = rows.sort_by("key")
                keys, matrix = order.column("key").combine_chunks(), _matrix(order.column("vector"))
                ids, asking = some.column("query_id").combine_chunks(), _matrix(some.column("vector"))
                number, names = keys.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
                for at in range(len(asking)):
                    score = np.round(matrix @ asking[at], DIGITS)
                    if skip_self:
                        score[number == names[at]] = -np.inf
                    best = np.argsort(-score, kind="stable")[:k] if k >= len(score) else _best(score, k)
                    best = best[np.isfinite(score[best])]
                    out[0] += [at] * len(best)
                    out[1] += best.tolist()
                    out[2] += score[best].tolist()
            table = [some.column("query_id").take(pa.array(out[0], pa.int64())), (order if out[0] else rows).column("key").take(pa.array(out[1], pa.int64())), pa.chunked_array([pa.array(out[2], pa.float64())])]
            lists = pa.chunked_array([np.full(len(out[0]), (rows if len(rows) else some).column("list")[0].as_py(), np.int32)])
            return pa.Table.from_arrays([*table, lists], ["query_id", "key", "score", "list"])

        cells = ["list", "piece", "block"]
        hits = left.select(*cells, "key", "vector").groupBy(*cells).cogroup(right.select(*cells, "query_id", "vector").groupBy(*cells)).applyInArrow(compare, f"query_id {kind}, key {own}, score double, list int")
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
        return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores, all ties of the last considered, earlier places first."""
    least = np.partition(score, len(score) - k)[len(score) - k]
    some = np.flatnonzero(score >= least)
    return some[np.argsort(-score[some], kind="stable")][:k]


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(queries, hits, recall) of (query_id, key) rows against the exact ones: the share of the exact rows that were found."""
    both = exact.select("query_id", "key").join(found.select("query_id", "key").withColumn("hit", F.lit(1)), ["query_id", "key"], "left")
    each = both.groupBy("query_id").agg(F.count("*").alias("n"), F.count("hit").alias("hits"))
    return each.agg(F.count("*").alias("queries"), F.sum("hits").alias("hits"), F.round(F.sum("hits") / F.sum("n"), 4).alias("recall"))
