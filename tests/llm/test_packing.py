"""Packing: cuts and ids against the library, capacities, and few sequences."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tesserine.llm import bpe, packing


def plain_fill(lengths, capacity, weights, rule):
    """Scores every open sequence for each piece."""
    bins, out = [], []
    for n in lengths:
        demand = (n, 1, n * n)
        room = [(k, b) for k, b in enumerate(bins) if all(x >= y for x, y in zip(b, demand, strict=True))]
        norm = lambda b: -sum(w * ((x - y) / c) ** 2 for w, x, y, c in zip(weights, b, demand, capacity, strict=True))  # noqa: B023, E731
        dot = lambda b: sum(w * x / c * y / c for w, x, y, c in zip(weights, b, demand, capacity, strict=True))  # noqa: B023, E731
        if not room:
            bins.append(capacity)
            k = len(bins) - 1
        else:
            k = max(room, key=lambda kb: (norm if rule == "norm" else dot)(kb[1]))[0]
        bins[k] = tuple(x - y for x, y in zip(bins[k], demand, strict=True))
        out.append((n, bins[k]))
    return len(bins), out


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("capacity", [(64, 64, 4096), (64, 3, 4096), (64, 64, 1600), (64, 4, 2000)])
def test_every_constraint_holds(rule, capacity):
    draw = np.random.default_rng(sum(capacity))
    lengths = np.sort(draw.integers(1, 40, 400))[::-1]
    weights = (1.0, 0.31, 0.17)
    bins, places = packing.fill(lengths, *capacity, weights, rule)
    held = defaultdict(list)
    for n, b, at in zip(lengths.tolist(), bins.tolist(), places.tolist(), strict=True):
        assert at == sum(held[b])
        held[b].append(n)
    for x in held.values():
        assert sum(x) <= capacity[0] and len(x) <= capacity[1] and sum(n * n for n in x) <= capacity[2]
    count, _ = plain_fill(lengths.tolist(), capacity, weights, rule)
    assert abs(len(held) - count) <= max(1, count // 50)  # only ties may be taken otherwise


def test_few_sequences():
    lengths = np.sort(np.random.default_rng(2).integers(1, 1025, 20_000))[::-1]
    bins, _ = packing.fill(lengths, 1024, 1024, 1024**2)
    assert bins.max() + 1 <= 1.01 * -(-lengths.sum() // 1024)


def test_pieces_and_sequences(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.tokenizer_path())
    texts = [None, "", "a", "word " * 63, "word " * 64, "word " * 200, "ünï 漢字 <|endoftext|> x", "repeated text"] + ["same row of words"] * 40
    rows = [(None if i == 3 else i % 30, t, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(4)
    cut = packing.pieces(docs, 64, with_ids=True).collect()
    wanted = sorted((-1 if d is None else d, *[*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in rows)
    found = defaultdict(list)
    whole = []
    for r in sorted(cut, key=lambda r: r.ordinal):
        key = -1 if r.doc_id is None else r.doc_id
        if r.piece == 0:
            found[key].append([])
        assert r.start == len(found[key][-1]) and r.length == len(r.ids) <= 64 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        found[key][-1] += r.ids
    whole = sorted((k, *ids) for k, each in found.items() for ids in each)
    assert whole == wanted
    assert all(r.length == 64 for r in cut if r.piece > 0)

    out = packing.packed_documents(docs, 64, group=20).collect()
    assert len(out) == len(cut)
    held = defaultdict(list)
    for r in out:
        held[r.sequence_id].append((r.offset, r.length))
    for x in held.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.packed_documents(docs.limit(0)).collect() == []
    few = packing.pack(packing.pieces(docs, 64), 64, documents=2, cost=4096, weights=(1, 1, 1), rule="dot").groupBy("sequence_id").count().collect()
    assert max(r["count"] for r in few) == 2
    with pytest.raises(ValueError, match="larger"):
        packing.pack(packing.pieces(docs, 64), 64, cost=100)
