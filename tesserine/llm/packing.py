"""Packing of token sequences by vector best fit.

Documents are encoded and cut; each piece demands tokens, one document and attention cost (its
length squared) of a sequence, which has a capacity of each. Pieces are placed by falling length.
Of the open sequences that have room for a piece under every constraint, the one is taken whose
residual after placing has the least weighted norm, or whose residual has the greatest weighted
dot product with the demand; without one a new sequence is opened. Sequences with equal
residuals are interchangeable, so a task scores residuals, not sequences.

Pieces are dealt to groups of a bounded number, each with its like of all lengths, and each group
is packed by one task. What this loses against packing all at once is about a sequence a group.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm import bpe, shared

END_ID = 2
GROUP = 1 << 17


def pieces(docs: DataFrame, size: int = 1024, end_id: int = END_ID, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ordinal and, if asked for, ids): each text encoded, ended by ``end_id`` and cut.

    Only documents of more than ``size`` ids are cut, into pieces of ``size``, the first of which
    is shorter where the length is no multiple. Null text is empty: one piece, the end id.
    ordinal numbers the rows of a task, so that equal rows can be told apart. Columns other than
    doc_id and text are left out. An empty table gives no rows.
    """
    path = path or bpe.tokenizer_path()
    shared.bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, ordinal long" + ", ids array<int>" * with_ids

    def run(batches):
        encoder = bpe._encoder(path)
        ordinal = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            of, numbers, parts = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encoder.encode(text), end_id], "<u4")
                cuts = [0, *range(len(ids) % size or min(size, len(ids)), len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    of.append(row)
                    numbers.append((k, a, b - a, zlib.crc32(ids[a:b].tobytes()), ordinal))
                    ordinal += 1
                    if with_ids:
                        parts.append(ids[a:b].astype(np.int32))
            columns = [batch.column("doc_id").take(pa.array(of, pa.int64()))]
            columns += [pa.array([n[i] for n in numbers], pa.int32() if i == 0 else pa.int64()) for i in range(5)]
            if with_ids:
                columns.append(pa.array(parts, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in schema.split(", ")])

    return shared.pick(docs, "doc_id", "text").mapInArrow(shared.trimmed(run), schema)


def fill(lengths: np.ndarray, tokens: int, documents: int, cost: int, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(bin, place in the bin) of pieces of these lengths, which must not rise.

    Of equally good residuals the one that came to be first is taken.
    """
    capacity = np.array([tokens, documents, cost], np.float64)
    weight = np.array(weights, np.float64)
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    least = int(lengths.min(initial=tokens))
    states: list[tuple[int, int, int]] = []  # residuals that open sequences have
    where: dict[tuple[int, int, int], int] = {}
    open_: list[list[int]] = []  # their sequences
    residual = np.empty((64, 3))
    opened = 0
    for i, length in enumerate(lengths.tolist()):
        demand = np.array([length, 1, length * length], np.float64)
        at = -1
        if states:
            left = residual[: len(states)]
            room = np.flatnonzero((left >= demand).all(axis=1))
            if len(room):
                if rule == "norm":
                    score = -((((left[room] - demand) / capacity) ** 2) @ weight)
                else:
                    score = (left[room] / capacity * (demand / capacity)) @ weight
                at = int(room[np.argmax(score)])
        if at < 0:
            bin_, before = opened, (tokens, documents, cost)
            opened += 1
        else:
            bin_, before = open_[at].pop(), states[at]
            if not open_[at]:  # the last residual takes the place of one that no sequence has
                last = len(states) - 1
                del where[before]
                if at != last:
                    states[at], open_[at], residual[at] = states[last], open_[last], residual[last]
                    where[states[at]] = at
                states.pop()
                open_.pop()
        bins[i], places[i] = bin_, tokens - before[0]
        after = (before[0] - length, before[1] - 1, before[2] - length * length)
        if after[0] >= least and after[1] and after[2] >= least * least:
            at = where.get(after, -1)
            if at < 0:
                at = where[after] = len(states)
                states.append(after)
                open_.append([])
                if at == len(residual):
                    residual = np.vstack([residual, np.empty_like(residual)])
                residual[at] = after
            open_[at].append(bin_)
    return bins, places


def pack(rows: DataFrame, tokens: int = 1024, documents: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 0.0, 0.0), rule: str = "norm", group: int = GROUP) -> DataFrame:
    """The columns of ``rows`` (as from ``pieces``, without ids) with sequence_id and offset.

    A sequence takes at most ``tokens`` tokens, ``documents`` pieces and ``cost`` attention cost
    (sum of squared lengths); None stands for what the tokens allow anyway. ``rule`` is ``norm``
    or ``dot``; weights are those of the three capacities. offset is the sum of the lengths
    placed before in the sequence, so offsets leave no gap. Equal rows are dealt by their ordinal,
    so they fill no group. No more than about ``group`` pieces are held by one task; the rows
    are staged. An empty table gives no rows.
    """
    documents, cost = documents or tokens, cost or tokens * tokens
    if cost < tokens * tokens and not rows.where(F.col("length") * F.col("length") > cost).isEmpty() or not rows.where(F.col("length") > tokens).isEmpty():
        raise ValueError("a piece is larger than a sequence may be")
    if rule not in ("norm", "dot"):
        raise ValueError(f"no such rule: {rule}")
    groups = max(1, -(-rows.count() // group))
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("ordinal", "piece", "ids_crc32"), F.lit(groups)))
    names = [*rows.columns, "sequence_id", "offset"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", sequence_id long, offset long"

    def run(table: pa.Table) -> pa.Table:
        number = table.column("group")[0].as_py()
        table = table.drop_columns("group").sort_by([("length", "descending"), ("ordinal", "ascending")])
        bins, places = fill(table.column("length").to_numpy(), tokens, documents, cost, weights, rule)
        out = pa.Table.from_arrays([*table.columns, pa.chunked_array([bins + (number << 32)]), pa.chunked_array([places])], names)
        shared.release()
        return out

    return dealt.groupBy("group").applyInArrow(run, schema)


def packed_documents(docs: DataFrame, size: int = 1024, path: str | None = None, **options) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of all pieces of ``docs``.

    Null, empty and very long texts, repeated rows and empty tables: see ``pieces`` and ``pack``.
    """
    rows = shared.stage(pieces(docs, size, path=path), "pieces")
    return pack(rows, size, **options).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
