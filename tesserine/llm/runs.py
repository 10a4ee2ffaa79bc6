"""Periodic runs of words, found on the harmonic grid with suffix arrays and range minima.

A run is a maximal stretch of words with smallest period p that holds at least ``times`` periods
and ``least`` words. For each period p the grid points are the words jp. A run of ``times``
periods or more holds ``times`` neighbouring grid points at least, so of each ``times - 1``
neighbouring pairs (jp, (j + 1)p) one is enough. For such a pair the longest common extension
forward (suffix array, its array of common prefixes and a sparse table of range minima) and
backward (the same of the reversed words) give the whole stretch with period p around it. The
smallest period of a stretch found by several is kept: the others are its multiples.

Before a pair is queried, a few words on each side are compared: a stretch long enough leaves at
least a known number of equal words before or after the grid point. Documents without a pair
left have no run, and no suffix array is built for them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserine.llm import shared
from tesserine.llm.words import SPACE, Words, pieces

#: Grid pairs compared at once.
PAIRS = 1 << 20
#: Words compared on a side of a grid point before its extension is queried.
PROBE = 4


class Extensions:
    """Longest common extensions to the right between places of one document.

    ``ids`` are the words of documents one after another, ``ends`` the end of the document of
    each word. The suffix array orders suffixes by document first, by doubling the compared width;
    only suffixes that are still equal to others are sorted again. A document of n words needs
    about 4 * log2(n) bytes a word.
    """

    def __init__(self, ids: np.ndarray, ends: np.ndarray) -> None:
        n = len(ids)
        key = ends.astype(np.int64) * (int(ids.max(initial=0)) + 1) + ids
        self.array = np.argsort(key, kind="stable").astype(np.int32)
        slots = np.arange(n, dtype=np.int64)
        levels = [self._ranked(np.full(n + 1, -1, np.int32), slots, key[self.array])]
        width = 1
        while True:
            rank = levels[-1]
            lead = rank[self.array]
            alone = np.append(lead[1:] != lead[:-1], True) & np.append(True, lead[1:] != lead[:-1]) if n else np.zeros(0, bool)
            slots = np.flatnonzero(~alone)
            if not len(slots):
                break
            open_ = self.array[slots]
            after = open_.astype(np.int64) + width
            second = np.where(after < ends[open_], rank[np.minimum(after, n)].astype(np.int64) + 1, 0)
            key = rank[open_].astype(np.int64) * (n + 2) + second
            order = np.argsort(key, kind="stable")
            self.array[slots] = open_[order]
            levels.append(self._ranked(rank.copy(), slots, key[order]))
            width *= 2
        self.rank = levels[-1]
        self.minima = self._minima(self._common(levels))

    def _ranked(self, rank: np.ndarray, slots: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Each suffix gets the slot of the first suffix equal to it in the width compared."""
        if len(key):
            head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            rank[self.array[slots]] = np.repeat(slots[head], np.diff(np.append(head, len(key)))).astype(np.int32)
        return rank

    def _common(self, levels: list[np.ndarray]) -> np.ndarray:
        """Length of the common prefix of each suffix and the next in order. Equal ranks mean equal words: no two suffixes of a document end alike."""
        a, b = self.array[:-1].astype(np.int64), self.array[1:].astype(np.int64)
        begin = a.copy()
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][a] == levels[k][b]
            a += same.astype(np.int64) << k
            b += same.astype(np.int64) << k
        return (a - begin).astype(np.int32)

    @staticmethod
    def _minima(common: np.ndarray) -> list[np.ndarray]:
        out = [common]
        while 2 << (len(out) - 1) <= len(common) and out[-1].any():
            half = 1 << (len(out) - 1)
            out.append(np.minimum(out[-1][:-half], out[-1][half:]))
        return out

    def query(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of equal words from places a and b on (a != b, same document)."""
        x, y = self.rank[a].astype(np.int64), self.rank[b].astype(np.int64)
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            if k >= len(self.minima):
                continue  # ranges so wide have a minimum of 0
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - (1 << int(k))])
        return out


def _grid(ids: np.ndarray, bounds: np.ndarray, least: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of the grid pairs that a few compared words don't refute."""
    n = np.diff(bounds)
    top = n // times
    doc = np.repeat(np.arange(len(n)), top)
    period = np.arange(1, len(doc) + 1) - np.repeat(np.cumsum(top) - top, top)
    count = (-(-n[doc] // period) - 2) // (times - 1) + 1
    total = np.cumsum(count)
    lo = 0
    while lo < len(doc):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        c = count[lo:hi]
        combo = np.repeat(np.arange(lo, hi), c)
        j = (np.arange(len(combo)) - np.repeat(np.cumsum(c) - c, c)) * (times - 1)
        p = period[combo]
        at = bounds[doc[combo]] + j * p
        hit = np.flatnonzero(ids[at] == ids[at + p])
        at, p, d = at[hit], p[hit], doc[combo[hit]]
        # equal words from the point on plus those before it: at least ``need``
        need = np.maximum(least - p, (times - 1) * p)
        ahead = (need + 2) // 2
        behind = need - ahead + 1
        fore, back = np.ones(len(at), bool), np.ones(len(at), bool)
        for t in range(PROBE):
            to = np.minimum(at + p + t, bounds[d + 1] - 1)
            fore &= (t >= ahead) | ((at + p + t == to) & (ids[to] == ids[to - p]))
            to = np.maximum(at - 1 - t, bounds[d])
            back &= (t >= behind) | ((at - 1 - t == to) & (ids[to] == ids[to + p]))
        keep = fore | back
        yield at[keep], p[keep]
        lo = hi


def word_runs(ids: np.ndarray, bounds: np.ndarray, least: int = 6, times: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period; document d is ``ids[bounds[d]:bounds[d + 1]]`` and starts are places in ``ids``."""
    if least < 1 or times < 2:
        raise ValueError("a run has two periods and one word at least")
    none = np.zeros(0, np.int64)
    found = list(_grid(ids, bounds, least, times))
    at, p = (np.concatenate([x[i] for x in found]) if found else none for i in (0, 1))
    if not len(at):
        return none, none, none
    docs, which = np.unique(np.searchsorted(bounds, at, "right") - 1, return_inverse=True)
    size = bounds[docs + 1] - bounds[docs]
    first = np.cumsum(size) - size
    chosen = np.concatenate([ids[bounds[d] : bounds[d + 1]] for d in docs])
    begin, end = np.repeat(first, size), np.repeat(first + size, size)
    shift = (bounds[docs] - first)[which]
    at = at - shift
    n = len(chosen)
    length = p + Extensions(chosen, end).query(at, at + p)
    inner = np.flatnonzero(at > begin[at])
    back = np.zeros(len(at), np.int64)
    back[inner] = Extensions(chosen[::-1], (n - begin)[::-1]).query(n - at[inner], n - at[inner] - p[inner])
    length += back
    keep = np.flatnonzero(length >= np.maximum(least, times * p))
    start, length, p = (at - back + shift)[keep], length[keep], p[keep]
    order = np.lexsort((p, length, start))
    start, length, p = start[order], length[order], p[order]
    smallest = np.append(True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])) if len(start) else np.zeros(0, bool)
    start, length, p = start[smallest], length[smallest], p[smallest]
    order = np.lexsort((p, start))
    return start[order], length[order], p[order]


def _numbered(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(exact number of each word, its length, the letters of all words)."""
    letters = words.data[~SPACE[words.data]]
    length = words.ends - words.starts
    offsets = np.append(0, np.cumsum(length))
    array = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(letters))])
    return array.dictionary_encode().indices.to_numpy(), length, letters


def _summary(least: int, times: int, texts: bool):
    def part(column: pa.Array) -> list[pa.Array]:
        words = Words(column)
        ids, length, letters = _numbered(words)
        bounds = words.bounds
        start, size, period = word_runs(ids, bounds, least, times)
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, start + period, 1)
        np.add.at(edge, start + size, -1)
        kept = np.cumsum(edge[:-1]) == 0
        # each kept word, followed by a blank
        spaced = np.full(int((length[kept] + 1).sum()), 32, np.uint8)
        inside = np.ones(len(spaced), bool)
        inside[np.cumsum(length[kept] + 1) - 1] = False
        spaced[inside] = letters[np.repeat(kept, length)]
        ends = np.append(0, np.cumsum(np.where(kept, length + 1, 0)))[bounds]
        data = spaced.tobytes()
        of = np.searchsorted(start, bounds)
        rows = []
        for d in range(len(column)):
            a, b, base = of[d], of[d + 1], bounds[d]
            runs = list(zip((start[a:b] - base).tolist(), size[a:b].tolist(), period[a:b].tolist(), strict=True))
            best = max(runs, key=lambda r: ((r[1] << 64) // r[2], -r[0], -r[2]), default=None)
            left = data[ends[d] : max(ends[d], ends[d + 1] - 1)]
            listed = "".join([f"{s},{n},{q}\n" for s, n, q in runs]).encode()
            rows.append((len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(left).hexdigest(), *((runs, left.decode()) if texts else ())))
        columns = list(zip(*rows, strict=True))
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])), pa.string()] * texts
        if texts:
            columns[7] = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for runs in columns[7]]
        return [pa.array(c, t) for c, t in zip(columns, types, strict=True)]

    def run(batches):
        for batch in batches:
            rest = [c for c in batch.schema.names if c != "text"]
            for a, b in pieces(batch.column("text")):
                cut = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([cut.column(c) for c in rest] + part(cut.column("text")), rest + _NAMES[: 9 if texts else 7])

    return shared.trimmed(run)


_NAMES = ["n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, texts: bool = True) -> DataFrame:
    """The other columns of ``docs`` with the periodic runs of its texts' words.

    n_runs; start, length, period and exponent_milli (floor of 1000 * length / period) of the run
    with the greatest length / period, ties by start, then period, null without a run;
    runs_sha256 of the lines ``start,length,period`` of all runs; collapsed_sha256 of the words
    left when each run keeps its first period only, joined by one space. With ``texts`` also runs
    (an array of structs) and collapsed (the words left).

    Words are runs of characters other than ``\\x20`` and ``\\x09-\\x0D``. Null and empty texts
    have no words and no runs. Rows are judged one by one, so repeated rows and ids, ties and
    null ids need no rule. Columns of the results' names are replaced. A document is held whole
    by one task, with about 100 bytes a word if it has a run. An empty table gives no rows.
    """
    shared.bounded_batches(docs.sparkSession)
    names = _NAMES[: 9 if texts else 7]
    docs = docs.drop(*names)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    kinds = ["long"] * 5 + ["string"] * 2 + ["array<struct<start:long,length:long,period:long>>", "string"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [f"{n} {k}" for n, k in zip(names, kinds, strict=False)])
    return docs.mapInArrow(_summary(least, times, texts), schema)
