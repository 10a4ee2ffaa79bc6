"""Substring dedup by relative Lempel-Ziv parsing against content-routed reference blocks.

The corpus is its own reference. A place is a window of ``window`` consecutive words of one
document. Places are routed by the least hash of their three-word runs (their minimizer), so
equal places meet in the same block, and neighbours of equal route travel as one passage, with
their words. A document needs to be parsed only against the blocks that its own passages are
routed to: no other block can hold a match of a window's length.

In a block the reference is made of all passages routed there, indexed by the first occurrence
of each window, by doc_id and place. Passages are factored greedily from left to right: where
the window at a place occurs in the reference in a smaller doc_id, a phrase (reference document,
position, length) begins at its first occurrence and takes further words as long as they equal
the reference's next words, even where these words have another, earlier occurrence. It is the
longest match with that occurrence, not the longest of all occurrences: which words are covered
is the same. At its end the window that straddles the border is looked up, so no covered word is
missed between two phrases; a window without a match is a literal and the parse goes on with
the next. A phrase has ``window`` words at least and so is always a duplicate span. Words are
compared as integers of the block's exact dictionary of words; hashes only propose candidates.

Before the shuffle each piece of input is parsed against itself in the same way; only places
not settled there travel. Blocks whose passages are too many for one task (a run of words that
is very frequent, or a passage that very many pieces hold) are split by piece, parsed, and what
is not settled in a part is routed again by the whole window, so equal windows meet once more:
one copy from each part and doc_id. Further copies of one doc_id (a passage that repeats within a
document, or in many rows of null id) stay behind as echoes and take over what is found for the
copy that was sent. Rows equal in doc_id and text are parsed once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.words import SPACE, grams, mix

_NO_ID = -(1 << 63)
_ROUTED = "block long, piece long, payload binary"
_PHRASES = ["doc_id", "row", "start", "n", "ref_doc", "ref_start"]
_PARSED_NAMES = [*_PHRASES, "kind", "block", "route", "payload"]
#: Kinds of parsed rows: a phrase; an echo of another place of the doc_id (ref_doc is then the row, ref_start the place of that one); windows routed again.
_PHRASE, _ECHO, _AGAIN = 0, 1, 2
#: Windows of one bucket in the join of echoes.
_BUCKET = 64
_PARSED = ", ".join(f"{c} {'binary' if c == 'payload' else 'long'}" for c in _PARSED_NAMES)
_BREAK = re.compile(rb"[\x20\x09-\x0d]")
_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
#: Bytes of text parsed at once; longer documents are cut with an overlap of one window.
PIECE_BYTES = 4 << 20
#: Bytes of text that a block is meant for; passages overlap, so it holds about three times as many.
BLOCK_BYTES = 2 << 20
#: Share of rows that block sizes are estimated from. They steer the split of blocks only; no result depends on them.
SIZED_SHARE = 1 / 32
#: A longer word is represented by its SHA-256 (with a tab, which no word holds).
LONG_WORD = 256
ANCHOR = 3


def cuts(data: bytes, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes that cut no word."""
    at = 0
    while at < len(data):
        found = _BREAK.search(data, at + limit) if len(data) - at > limit else None
        end = found.start() if found else len(data)
        yield at, end
        at = end


class Passages:
    """Word runs of documents: the words joined by blanks, their exact numbers and hashes.

    Passage p is ``length[p]`` words of document ``doc[p]`` (row key ``row[p]``), from its word
    ``start[p]`` on. Passages must be ordered by doc, so that the first of equal places is the
    one of the least document.
    """

    def __init__(self, text: bytes, doc: np.ndarray, row: np.ndarray, start: np.ndarray, length: np.ndarray, window: int) -> None:
        self.text, self.doc, self.row, self.start, self.length, self.window = text, doc, row, start, length, window
        borders = np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1
        self.offsets = np.append(np.int32(0), borders.astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(borders), [None, pa.py_buffer(self.offsets), pa.py_buffer(text)]).dictionary_encode()
        self.ids = words.indices.to_numpy()
        self.vocabulary = words.dictionary
        self.first = (np.cumsum(length) - length).astype(np.int32)
        count = np.maximum(length - window + 1, 0)
        self.passage = np.repeat(np.arange(len(length), dtype=np.int32), count)
        self.at = np.arange(len(self.passage), dtype=np.int32)  # the first word of each window
        self.at += np.repeat(self.first - (np.cumsum(count) - count).astype(np.int32), count)

    def place(self, windows: np.ndarray) -> np.ndarray:
        """Where windows begin in their documents."""
        p = self.passage[windows]
        return self.start[p] + (self.at[windows] - self.first[p])

    def first_equal(self) -> np.ndarray:
        """For each window the first window of equal words, compared word by word."""
        n, ids, at = len(self.at), self.ids, self.at
        seeds = mix(np.arange(1, len(self.vocabulary) + 1, dtype=np.uint64))[ids]
        seeds = grams(seeds, self.window)[at]
        order = np.argsort(seeds, kind="stable").astype(np.int32)
        seeds = seeds[order]
        head = np.append(True, seeds[1:] != seeds[:-1]) if n else np.zeros(0, bool)
        del seeds
        first = np.empty(n, np.int32)
        first[order] = order[np.flatnonzero(head)][np.cumsum(head, dtype=np.int32) - 1]
        del order, head
        later = np.flatnonzero(first != np.arange(n, dtype=np.int32))
        a, b = at[later], at[first[later]]
        same = np.ones(len(later), bool)
        for t in range(self.window):
            same &= ids[a + t] == ids[b + t]
        if not same.all():  # windows whose hash is that of other words are grouped by the words themselves
            odd = later[~same]
            _, lead, which = np.unique(ids[at[odd][:, None] + np.arange(self.window)], axis=0, return_index=True, return_inverse=True)
            first[odd] = odd[lead[which.ravel()]]
        return first

    def _reach(self, a: int, b: int, most: int) -> int:
        """How many words from places a and b on are equal, up to ``most``."""
        done, step = 0, 64
        while done < most:
            n = min(step, most - done)
            odd = np.flatnonzero(self.ids[a + done : a + done + n] != self.ids[b + done : b + done + n])
            if len(odd):
                return done + int(odd[0])
            done, step = done + n, 2 * step
        return most

    def phrases(self, first: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(whether a window is settled, (doc, row, start, n, ref_doc, ref_start) of the phrases, n in windows)."""
        doc = self.doc[self.passage]
        settled = doc[first] < doc
        del doc
        w = np.flatnonzero(settled)
        if not len(w):
            return settled, tuple(np.zeros(0, np.int64) for _ in range(6))
        own, ref = self.at[w], self.at[first[w]]
        begin = np.flatnonzero(np.append(True, (own[1:] != own[:-1] + 1) | (ref[1:] != ref[:-1] + 1)))
        n = np.diff(np.append(begin, len(w)))
        begin, n = self._greedy(w, first, begin, n)
        w = w[begin]
        lead = first[w]
        return settled, (self.doc[self.passage[w]], self.row[self.passage[w]], self.place(w), n, self.doc[self.passage[lead]], self.place(lead))

    def _greedy(self, w: np.ndarray, first: np.ndarray, begin: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin where another ends, drawn out as far as the reference of each goes on."""
        linked = np.append(self.at[w[begin[1:]]] == self.at[w[begin[:-1]]] + n[:-1], False)
        if not linked.any():
            return begin, n
        heads = np.flatnonzero(~np.append(False, linked[:-1]))  # of stretches of settled windows
        alone = ~linked[heads]
        starts, sizes = [begin[heads[alone]]], [n[heads[alone]]]
        ends = np.append(begin, len(w))[np.append(heads[1:], len(begin))]
        for at, end in zip(begin[heads[~alone]].tolist(), ends[~alone].tolist(), strict=True):
            some, counts = [], []
            while at < end:
                lead = int(first[w[at]])
                a, b, p = int(self.at[w[at]]), int(self.at[lead]), int(self.passage[lead])
                most = min(end - at + self.window - 1, int(self.first[p] + self.length[p]) - b)
                some.append(at)
                counts.append(self._reach(a, b, most) - self.window + 1)
                at += counts[-1]
            starts.append(np.array(some))
            sizes.append(np.array(counts))
        begin, n = np.concatenate(starts), np.concatenate(sizes)
        order = np.argsort(begin, kind="stable")
        return begin[order], n[order]

    def echoes(self, first: np.ndarray, chosen: np.ndarray) -> tuple:
        """(doc, row, start, n, row of the first copy, its place) of chosen windows, which their document also holds before; neighbours together."""
        w = np.flatnonzero(chosen)
        own, ref = self.at[w], self.at[first[w]]
        begin = np.flatnonzero(np.append(True, (own[1:] != own[:-1] + 1) | (ref[1:] != ref[:-1] + 1))) if len(w) else w
        n = np.diff(np.append(begin, len(w)))
        w = w[begin]
        lead = first[w]
        return self.doc[self.passage[w]], self.row[self.passage[w]], self.place(w), n, self.row[self.passage[lead]], self.place(lead)

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every piece and block."""
        known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        return known[self.ids] if len(known) else np.zeros(0, np.uint64)

    def routes(self) -> np.ndarray:
        """The minimizer of each window."""
        runs, n = mix(grams(self.word_hashes(), ANCHOR)), self.window - ANCHOR + 1
        width = 1
        while width * 2 <= n:
            runs = np.minimum(runs[:-width], runs[width:])
            width *= 2
        if n > width:
            runs = np.minimum(runs[: len(runs) - (n - width)], runs[n - width :])
        return runs[self.at]

    def routed(self, chosen: np.ndarray, route: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(route, payload) of the chosen windows; neighbours of equal route make one passage."""
        w = np.flatnonzero(chosen)
        if not len(w):
            return
        at, to = self.at[w], route[w]
        begin = np.flatnonzero(np.append(True, (at[1:] != at[:-1] + 1) | (to[1:] != to[:-1])))
        length = np.diff(np.append(begin, len(w))) + self.window - 1
        order = np.argsort(to[begin], kind="stable")
        begin, length = begin[order], length[order]
        lead, to = w[begin], to[begin]
        a, b = self.offsets[self.at[lead]], self.offsets[self.at[lead] + length]
        doc, row, place = self.doc[self.passage[lead]], self.row[self.passage[lead]], self.place(lead)
        edges = np.flatnonzero(np.append(np.append(True, to[1:] != to[:-1]), True))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            text = b"".join([self.text[i:j] for i, j in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True)])
            yield int(to[x]), _packed(text, doc[x:y], row[x:y], place[x:y], length[x:y])


def _packed(text: bytes, *numbers: np.ndarray) -> bytes:
    """Arrays of equal length and the words, compressed where that pays."""
    raw = len(numbers[0]).to_bytes(4, "little") + len(numbers).to_bytes(1, "little") + b"".join(x.astype("<i8").tobytes() for x in numbers) + text
    return b"\1" + zstandard.ZstdCompressor(level=6).compress(raw) if len(raw) > 512 else b"\0" + raw


def _unpacked(payload: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(payload[1:]) if payload[0] else payload[1:]
    n, k = int.from_bytes(raw[:4], "little"), raw[4]
    return [np.frombuffer(raw, "<i8", n, 5 + 8 * n * i) for i in range(k)], raw[5 + 8 * n * k :]


def _joined(words: list[bytes]) -> bytes:
    return b"".join([(w if len(w) <= LONG_WORD else b"\t" + hashlib.sha256(w).hexdigest().encode()) + b" " for w in words])


def _spaced(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words of a buffer, each followed by one blank."""
    length = ends - starts
    if length.max(initial=0) > LONG_WORD:
        raw = data.tobytes()
        return _joined([raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    out = np.full(int((length + 1).sum()), 32, np.uint8)
    letters = np.ones(len(out), bool)
    letters[np.cumsum(length + 1) - 1] = False
    out[letters] = data[inside]
    return out.tobytes()


def _documents(batches, window: int, limit: int) -> Iterator[Passages]:
    """Pieces of the input of bounded size, ordered by doc_id."""

    def piece(rows: list[tuple[int, int, int, bytes]]) -> Passages:
        rows.sort(key=lambda r: r[0])
        data = np.frombuffer(b" ".join([r[3] for r in rows]), np.uint8)
        inside = ~SPACE[data]
        border = np.zeros(1, np.int8)
        edge = np.diff(np.concatenate((border, inside.view(np.int8), border)))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r[3]) + 1 for r in rows)]))
        return Passages(_spaced(data, inside, starts, ends), *(np.array([r[i] for r in rows], np.int64) for i in range(3)), np.diff(bounds), window)

    held, size = [], 0
    for batch in batches:
        for doc, row, text in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), batch.column("text"), strict=True):
            data, first = text.as_buffer().to_pybytes() if text.is_valid else b"", 0
            for at, end in cuts(data, limit):
                to = end
                if end < len(data):  # the windows that begin in this part end in the next words
                    for _, word in zip(range(window - 1), _WORD.finditer(data, end), strict=False):
                        to = word.end()
                if size + to - at > limit and held:
                    yield piece(held)
                    held, size = [], 0
                held.append((doc, row, first, data[at:to]))
                size += to - at
                if end < len(data):
                    first += len(data[at:end].split())
    if held:
        yield piece(held)


def _route(window: int, blocks: int, piece_bytes: int):
    """(block, piece, payload) of the windows that a piece doesn't settle; phrases settled in it have a negative block."""

    def run(batches):
        for p in _documents(batches, window, piece_bytes):
            settled, found = p.phrases(p.first_equal())
            route = (p.routes() % np.uint64(blocks)).astype(np.int64)
            number = int(mix(p.row[:1].astype(np.uint64))[0] >> np.uint64(1))
            rows = p.routed(~settled, route)
            if len(found[0]):
                rows = chain([(-1 - number % blocks, _packed(b"", *found))], rows)
            while some := list(islice(rows, 256)):
                block, payload = zip(*some, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array([number] * len(some), pa.int64()), pa.array(payload, pa.binary())], ["block", "piece", "payload"])

    return shared.trimmed(run)


def _sized(window: int, blocks: int, piece_bytes: int):
    """(block, bytes) of what the pieces send."""

    def run(batches):
        for p in _documents(batches, window, piece_bytes):
            block, n = np.unique((p.routes() % np.uint64(blocks)).astype(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array((n * (len(p.text) / max(1, len(p.ids))) * 3).astype(np.int64))], ["block", "bytes"])

    return shared.trimmed(run)


def _parse(window: int):
    """The phrases of one part of a block. Where the block has several parts, also the windows that the part doesn't settle, routed again."""

    def run(table: pa.Table) -> pa.Table:
        block, parts = table.column("block")[0].as_py(), table.column("parts")[0].as_py()
        numbers, texts = zip(*map(_unpacked, table.column("payload").to_pylist()), strict=True)
        again: list[tuple[int, bytes]] = []
        echoes = [np.zeros(0, np.int64)] * 6
        if block < 0:
            found = [np.concatenate(x) for x in zip(*numbers, strict=True)]
        else:
            doc, row, start, length = (np.concatenate(x) for x in zip(*numbers, strict=True))
            text = b"".join(texts)
            order = np.argsort(doc, kind="stable")
            ends = np.append(0, np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1)
            first = np.cumsum(length) - length
            text = b"".join([text[a:b] for a, b in zip(ends[first[order]].tolist(), ends[(first + length)[order]].tolist(), strict=True)])
            p = Passages(text, doc[order], row[order], start[order], length[order], window)
            first = p.first_equal()
            settled, found = p.phrases(first)
            if parts > 1:
                whole = mix(grams(p.word_hashes(), window))[p.at]
                lead = first == np.arange(len(first))
                again = list(p.routed(~settled & lead, (whole % np.uint64(4 * parts)).astype(np.int64)))
                echoes = p.echoes(first, ~settled & ~lead)
        n, m, more = len(found[0]), len(echoes[0]), len(again)
        columns = [pa.array(np.concatenate([x, y, np.zeros(more, np.int64)]), pa.int64()) for x, y in zip(found, echoes, strict=True)]
        columns.append(pa.array(np.repeat([_PHRASE, _ECHO, _AGAIN], [n, m, more]), pa.int64()))
        columns += [pa.array(np.full(n + m + more, block, np.int64)), pa.array([0] * (n + m) + [r for r, _ in again], pa.int64()), pa.array([None] * (n + m) + [x for _, x in again], pa.binary())]
        shared.release()
        return pa.table(columns, _PARSED_NAMES)

    return run


def _distinct(docs: DataFrame) -> DataFrame:
    """One row of those equal in doc_id and row; only texts that repeat are shuffled."""
    repeated = shared.stage(docs.groupBy("doc_id", "row").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("id"), F.col("row").alias("key")), "repeated")
    n = repeated.count()
    if not n:
        return docs
    if n <= shared.BROADCAST_ROWS:
        repeated = F.broadcast(repeated)
    same = (F.col("doc_id") == F.col("id")) & (F.col("row") == F.col("key"))
    return docs.join(repeated, same, "left_anti").unionByName(docs.join(repeated, same, "left_semi").groupBy("doc_id", "row").agg(F.max("text").alias("text")))


def phrases(docs: DataFrame, window: int = 13, block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, share: float = SIZED_SHARE) -> DataFrame:
    """The phrases of the parse: (doc_id, row, start, n, ref_doc, ref_start).

    docs: doc_id (not null), row (a key of the text), text. The n windows of a document from its
    word ``start`` on equal those of the document ``ref_doc``, a smaller doc_id, from its word
    ``ref_start`` on: n + window - 1 words. Every window that an earlier document holds lies in
    a phrase; windows that only repeat within one doc_id lie in none. Words longer than
    LONG_WORD bytes are compared by SHA-256.
    """
    docs = _distinct(docs.select("doc_id", "row", "text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(64, total // block_bytes)
    limit = 12 * block_bytes  # four times what a block is meant for
    sized = docs.where(F.pmod(F.xxhash64("doc_id", "row", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))).mapInArrow(_sized(window, blocks, piece_bytes), "block long, bytes long")
    hot = sized.groupBy("block").agg((F.sum("bytes") / F.lit(share)).alias("bytes")).where(F.col("bytes") > limit)
    hot = shared.stage(hot.select("block", F.ceil(F.col("bytes") / limit).alias("parts")), "hot")
    n_hot = hot.count()

    routed = docs.mapInArrow(_route(window, blocks, piece_bytes), _ROUTED)
    if n_hot:
        routed = routed.join(F.broadcast(hot) if n_hot <= shared.BROADCAST_ROWS else hot, "block", "left").withColumn("parts", F.coalesce("parts", F.lit(1)).cast("long"))
    else:
        routed = routed.withColumn("parts", F.lit(1).cast("long"))
    first = routed.withColumn("part", F.pmod("piece", "parts")).groupBy("block", "part").applyInArrow(_parse(window), _PARSED)
    if not n_hot:
        return first.select(*_PHRASES)
    first = shared.stage(first, "parsed")
    left = first.where(F.col("kind") == _AGAIN).select("block", "route", F.lit(1).cast("long").alias("parts"), "payload")
    second = left.groupBy("block", "route").applyInArrow(_parse(window), _PARSED).select(*_PHRASES)
    out = first.where(F.col("kind") == _PHRASE).select(*_PHRASES)
    echoes = first.where(F.col("kind") == _ECHO)
    if echoes.isEmpty():
        return out.unionByName(second)
    second = shared.stage(second, "settled")
    return out.unionByName(second).unionByName(_echoed(echoes.select(*_PHRASES), second))


def _echoed(echoes: DataFrame, settled: DataFrame) -> DataFrame:
    """The phrases of echoes: where the copy that they repeat is settled, in pieces of a bucket of windows. Both sides are cut at buckets, so only pieces that overlap meet."""
    buckets = lambda start: F.explode(F.sequence(F.expr(f"{start} div {_BUCKET}"), F.expr(f"({start} + n - 1) div {_BUCKET}")))
    left = echoes.withColumn("bucket", buckets("ref_start")).alias("e")
    right = settled.withColumn("bucket", buckets("start")).alias("s")
    same = "e.doc_id = s.doc_id AND e.ref_doc = s.row AND e.bucket = s.bucket AND s.start < e.ref_start + e.n AND e.ref_start < s.start + s.n"
    begin = F.greatest(F.col("e.ref_start"), F.col("s.start"), F.col("e.bucket") * _BUCKET)
    end = F.least(F.expr("e.ref_start + e.n"), F.expr("s.start + s.n"), (F.col("e.bucket") + 1) * _BUCKET)
    cut = left.join(right, F.expr(same)).withColumn("begin", begin).withColumn("n_cut", end - begin).where("n_cut > 0")
    return cut.selectExpr("e.doc_id", "e.row", "e.start + (begin - e.ref_start) AS start", "n_cut AS n", "s.ref_doc", "s.ref_start + (begin - s.start) AS ref_start")


def _merged(window: int):
    """Word intervals that the phrases of a document cover, merged: pairs of begin and end."""

    def run(batches):
        for batch in batches:
            out = []
            for spans in batch.column("spans"):
                starts = spans.values.field("start").to_numpy()
                ends = starts + spans.values.field("n").to_numpy() + window - 1
                order = np.argsort(starts, kind="stable")
                starts, reach = starts[order], np.maximum.accumulate(ends[order])
                first = np.flatnonzero(np.append(True, starts[1:] > reach[:-1]))
                out.append(np.column_stack([starts[first], reach[np.append(first[1:] - 1, len(reach) - 1)]]).astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(out, pa.binary())], ["doc_id", "row", "spans"])

    return run


def duplicate_spans(docs: DataFrame, window: int = 13, **options) -> DataFrame:
    """(doc_id, row, spans): the word intervals of each row that has any, packed as 64-bit begins and ends."""
    found = phrases(docs, window, **options)
    return found.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "n")).alias("spans")).mapInArrow(_merged(window), "doc_id long, row long, spans binary")


def _cut(texts: bool):
    def one(data: bytes, spans: np.ndarray) -> tuple[int, int, list[bytes]]:
        """Words, words removed, and the words left, joined by blanks, a part of a long text at a time."""
        total, removed, left = 0, 0, []
        for at, end in cuts(data, PIECE_BYTES):
            words = data[at:end].split()  # bytes.split() cuts at \x20 and \x09-\x0D
            inside = np.clip(spans - total, 0, len(words)).tolist()
            total += len(words)
            keep, begin = [], 0
            for a, b in inside:
                if b > a:
                    keep += words[begin:a]
                    begin = b
                    removed += b - a
            keep += words[begin:]
            if keep:
                left.append(b" ".join(keep))
        return total, removed, left

    def run(batches):
        for batch in batches:
            kept, totals, removals = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                total, removed, left = one((text or "").encode(), np.frombuffer(spans or b"", "<i8").reshape(-1, 2))
                totals.append(total)
                removals.append(removed)
                if not texts:
                    kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
                else:
                    kept.append(b" ".join(left).decode() if removed else text)
            rest = [c for c in batch.schema.names if c not in ("text", "spans")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(totals, pa.int64()), pa.array(removals, pa.int64()), pa.array(kept, pa.string())], rest + ["n_words", "n_removed", "kept"])

    return shared.trimmed(run)


def substring_dedup(docs: DataFrame, window: int = 13, texts: bool = True, **options) -> DataFrame:
    """Remove every word that lies in a window whose words also start in an earlier document.

    Windows are judged on the input. Returns the other columns of ``docs`` with n_words,
    n_removed and kept: the text that is left (its words joined by one space; a text that
    loses nothing stays as it is), or with ``texts=False`` the SHA-256 of the kept words.
    Null text has no words; texts under ``window`` words lose nothing. A null doc_id counts as
    smaller than any other. Rows with equal doc_id don't remove each other's words, and each
    is cut by what its own text shares with earlier documents (rows are told apart by doc_id
    and text). Columns named n_words, n_removed, kept or spans are replaced, others are kept.
    An empty table gives no rows.
    """
    shared.bounded_batches(docs.sparkSession)
    docs = docs.drop("n_words", "n_removed", "kept", "spans")
    key, row, found, text = shared.unused(docs, "key", "row", "found_key", "found_row")
    keyed = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn(row, F.xxhash64("text"))
    spans = duplicate_spans(keyed.select(F.col(key).alias("doc_id"), F.col(row).alias("row"), "text"), window, **options)
    spans = shared.stage(spans, "spans").select(F.col("doc_id").alias(found), F.col("row").alias(text), "spans")
    joined = keyed.join(spans, (F.col(key) == F.col(found)) & (F.col(row) == F.col(text)), "left").drop(key, row, found, text)
    rest = [f for f in docs.schema.fields if f.name != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", n_words long, n_removed long, kept string"
    return joined.mapInArrow(_cut(texts), schema)
