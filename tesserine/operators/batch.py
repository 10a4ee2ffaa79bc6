"""Retrieval for many questions in one plan: lexical and vector candidates, fusion, rerank, each grouped by question.

A question is a row, so the number of jobs doesn't depend on how many there are. Ranks within a
question are cut to what is needed before rows are shuffled, as the optimizer does for a
filtered row number.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import tokens
from tesserine.operators import models, postings
from tesserine.operators.ann import VectorIndex
from tesserine.plans.staging import staged

#: Sizes: candidates of each list, the constant of the fusion, the fused pool, the hits that are reranked.
BM25, KNN, RRF, POOL, RERANKED = 300, 50, 60, 200, 60
#: Words of questions that are broadcast, postings that a task is meant to sum up, and scores that it holds at a time.
ASKED, DEALT, ROWS = 100_000, 1_000_000, 1 << 20


def best(rows: DataFrame, k: int, key: str = "key") -> DataFrame:
    """The k best of each query by score, ties to the smaller key, with rank from 1."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _cut(held: dict[str, np.ndarray], least: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows that may be among the ``most`` best of their query; ``least`` takes the last place's score of each full query. Rows whose rounding is in doubt stay."""
    sure = np.flatnonzero(held["sure"])
    q, score = held["query"][sure], held["rounded"][sure]
    order = np.lexsort((held["row"][sure], -score, q))
    q, score = q[order], score[order]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])[: len(q)])
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    last = np.flatnonzero(place == most - 1)
    least[q[last]] = score[last]
    return np.append(sure[order[place < most]], np.flatnonzero(~held["sure"]))


def _scores(numbers: np.ndarray, cells: np.ndarray, fields: np.ndarray, names: pa.Array, n_fields: int, digits: int, most: int | None):
    """Postings (key, cell, part) in the order of their keys as (query, key, score), where ``numbers`` of names ask for ``cells`` of ``fields``, sorted by cell: the greatest of the fields' sums; with ``most``, at least the best of each query in the task.

    Rows of a task come by key, so a row that only equals the last of a full query comes after it.
    """
    first = np.searchsorted(cells, np.arange(len(fields) + 1))
    n, times = len(names), np.diff(first)
    width = n * n_fields

    def scored(row, cell, part):
        """(row, query, score) of the rows that a query asks for: ROWS places of rows, queries and fields at a time."""
        at = 0
        asked = np.cumsum(times[cell])
        while at < len(row):
            far = np.searchsorted(row, row[at] + max(1, ROWS // width))
            full = np.searchsorted(asked, (asked[at - 1] if at else 0) + ROWS, "right")
            full = np.searchsorted(row, row[full]) if full < len(row) else full
            to = max(np.searchsorted(row, row[at], "right"), min(far, full))  # one row at least, whole rows
            c, base = cell[at:to], row[at]
            k = times[c]
            of = np.repeat(np.arange(to - at), k)
            query = numbers[np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first[c], k)]
            flat = ((row[at:to][of] - base) * n + query) * n_fields + fields[c][of]
            shape = (row[to - 1] - base + 1, n, n_fields)
            hit = np.zeros(shape, bool)
            hit.ravel()[flat] = True
            score = np.where(hit, np.bincount(flat, part[at:to][of], hit.size).reshape(shape), -np.inf).max(axis=2)
            r, q = np.nonzero(hit.any(axis=2))
            yield r + base, q, score[r, q]
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least, rest, seen = np.full(n, -np.inf), None, 0
        held, keys = None, None

        def out(query, key, score):
            return pa.RecordBatch.from_arrays([names.take(pa.array(query)), key, pa.array(score)], ["query", "key", "score"])

        for batch in _then_none(batches):
            parts = [b for b in (rest, batch) if b is not None and len(b)]
            if not parts:
                continue
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            code = whole.column("key").dictionary_encode("encode").indices.to_numpy()
            head = np.append(True, code[1:] != code[:-1])
            end = len(code) if batch is None else int(np.flatnonzero(head)[-1])  # the last key may go on in the next batch
            rest = whole.slice(end)
            if not end:
                continue
            head = head[:end]
            begin = np.flatnonzero(head)
            for row, query, score in scored(np.cumsum(head) - 1, whole.column("cell").to_numpy()[:end], whole.column("part").to_numpy()[:end]):
                key = whole.column("key").take(pa.array(begin[row]))
                if most is None:
                    yield out(query, key, score)
                    continue
                scaled = score * 10.0**digits
                new = {"query": query, "row": row + seen, "score": score, "rounded": np.floor(scaled + 0.5), "sure": np.abs(scaled - np.floor(scaled) - 0.5) > 1e-3}
                good = np.flatnonzero(~new["sure"] | (new["rounded"] > least[query]))
                new = {name: column[good] for name, column in new.items()}
                key = key.take(pa.array(good))
                held = {name: np.append(held[name], column) for name, column in new.items()} if held else new
                keys = pa.concat_arrays([keys, key]) if keys is not None else key
                if len(keys) > ROWS + n * most:
                    some = _cut(held, least, most)
                    held, keys = {name: column[some] for name, column in held.items()}, keys.take(pa.array(some))
            seen += len(begin)
        if held:
            some = _cut(held, least, most)
            yield out(held["query"][some], keys.take(pa.array(some)), held["score"][some])

    return run


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def matches(index: postings.Index, questions: DataFrame, fields: Mapping[str, float], digits: int = 6, most: int | None = None) -> DataFrame:
    """(query, key, score): for each question the greatest of the boosted field scores of each row that holds one of its words.

    questions: query, text. Null text has no words. Rows of one query are one question; equal
    words count once. With ``most``, at least the ``most`` best of each question by score and key:
    no task hands on more. Up to ASKED words of questions, postings meet them by a broadcast, and
    those that are asked for are dealt by key, once, whatever the number of questions; a task sums
    up the parts of its rows. Beyond it the join is a shuffle by (bucket, field, term).
    """
    spark = index.spark
    held = [(f, float(boost), *index.stats[f]) for f, boost in fields.items() if f in index.stats]
    if not held:
        return questions.select("query", F.lit(None).alias("key"), F.lit(0.0).alias("score")).limit(0)
    parts = F.array(*[F.struct(F.lit(i).alias("number"), F.lit(f).alias("field"), F.lit(boost).alias("boost"), F.lit(n).alias("n"), F.lit(float(mean or 1.0)).alias("avgdl")) for i, (f, boost, n, mean) in enumerate(held)])
    asked = questions.select("query", F.explode(tokens(F.coalesce("text", F.lit("")))).alias("term")).distinct()
    asked = asked.select("query", "term", postings._bucket(F.col("term"), index.buckets).alias("bucket"), F.inline(parts))
    cell = ["bucket", "field", "term"]
    weighed = staged(asked.join(spark.read.parquet(f"{index.path}/terms").select(*cell, "df"), cell).withColumn("idf", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))), "asked")
    part = F.col("idf") * F.col("tf") / (F.col("tf") + postings.K1 * (1 - postings.B + postings.B * F.col("dl") / F.col("avgdl"))) * F.col("boost")
    stored = index.postings.select(*cell, "key", "tf", "dl")
    if weighed.count() > ASKED:
        found = weighed.join(stored, cell)
        sums = found.groupBy("query", "key").agg(*[F.sum(F.when(F.col("number") == i, part)).alias(f"s{i}") for i in range(len(held))])
        score = F.greatest(*[f"s{i}" for i in range(len(held))]) if len(held) > 1 else F.col("s0")
        return sums.select("query", "key", F.round(score, digits).alias("score"))
    rows = weighed.select("query", *cell, "number", "df").toArrow()  # ASKED rows at most
    places = list(zip(*[rows.column(c).to_pylist() for c in cell], strict=True))
    cells = {place: i for i, place in enumerate(dict.fromkeys(places))}
    at, owner, df = np.array([cells[p] for p in places], np.int64), np.zeros(len(cells), np.int64), np.zeros(len(cells), np.int64)
    owner[at], df[at] = rows.column("number").to_numpy(), rows.column("df").to_numpy()
    query, order = rows.column("query").combine_chunks().dictionary_encode("encode"), np.argsort(at, kind="stable")
    number = spark.createDataFrame([(*place, i) for place, i in cells.items()], "bucket int, field string, term string, cell int")
    known = weighed.select(*cell, "idf", "avgdl", "boost").distinct().join(F.broadcast(number), cell)
    tasks = max(spark.sparkContext.defaultParallelism, 1 + int(df.sum()) // DEALT)
    met = stored.join(F.broadcast(known), cell).select("key", "cell", part.alias("part")).repartition(tasks, "key").sortWithinPartitions("key")
    kinds = [f"{name} {frame.schema[name].dataType.simpleString()}" for name, frame in (("query", questions), ("key", stored))]
    run = _scores(query.indices.to_numpy()[order], at[order], owner, query.dictionary, len(held), digits, most)
    return met.mapInArrow(run, ", ".join([*kinds, "score double"])).select("query", "key", F.round("score", digits).alias("score"))


def fuse(lists: Sequence[DataFrame], k: int = RRF) -> DataFrame:
    """(query, key, score) from lists of (query, key, rank): the sum of 1 / (k + rank)."""
    union = lists[0].select("query", "key", "rank")
    for hits in lists[1:]:
        union = union.unionByName(hits.select("query", "key", "rank"))
    return union.groupBy("query", "key").agg(F.round(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))), 9).alias("score"))


def retrieve(questions: DataFrame, index: postings.Index, fields: Mapping[str, float], vectors: VectorIndex | None = None, probes: int | None = None, allowed: DataFrame | None = None, pool: int = POOL) -> DataFrame:
    """(query, key, score, rank): the fused pool of each question.

    questions: query, text and, for ``vectors``, vector; a null vector has no neighbours.
    allowed: (query, key) rows that a question may find, for instance by repository; the filter
    is applied before any ranking.
    """
    kept = lambda rows: rows if allowed is None else rows.join(allowed.select("query", "key"), ["query", "key"], "left_semi")
    lists = [best(kept(matches(index, questions, fields, most=BM25 if allowed is None else None)), BM25)]
    if vectors is not None:
        asked = questions.select(F.col("query").alias("query_id"), "vector")
        every = len(vectors.means)
        near = vectors.search(asked, KNN, probes or every).withColumnRenamed("query_id", "query")
        lists.append(near if allowed is None else best(kept(near.drop("rank")), KNN))
    return best(fuse(lists), pool)


def fused_and_reranked(hits: DataFrame, texts: DataFrame, factory: models.Factory | None, k: int = 10, reranked: int = RERANKED) -> DataFrame:
    """(query, key, score, rank, rerank_score, rerank_rank): the k best of a fused pool after its first ``reranked`` hits are scored as pairs; the pool's order without a model.

    texts: (query, key, pair_text) of at least the hits that are scored; a missing one counts as empty.
    """
    few = hits.where(F.col("rank") <= max(k, reranked))
    pairs = few.join(texts.select("query", "key", "pair_text"), ["query", "key"], "left")
    ranked = models.rerank(pairs, factory, "query", "key", "pair_text", reranked)
    return ranked.where(F.col("rerank_rank") <= k).select("query", "key", "score", "rank", "rerank_score", "rerank_rank")
