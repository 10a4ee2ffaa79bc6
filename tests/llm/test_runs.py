"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tesserine.llm import registry, runs


def brute(words, least=6, times=4):
    """All (start, length, smallest period), by walking every period."""
    found = {}
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            if words[i] != words[i + p]:
                i += 1
                continue
            start = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i - start + p >= max(least, times * p):
                found.setdefault((start, i - start + p), p)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(words, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def expected(doc_id, words):
    found = brute(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {"doc_id": doc_id, "n_runs": len(found), "start": best and best[0], "length": best and best[1], "period": best and best[2], "exponent_milli": best and 1000 * best[1] // best[2], "runs_sha256": sha(listed), "collapsed_sha256": sha(collapsed(words, found))}


@pytest.mark.parametrize(("least", "times"), [(6, 4), (1, 2), (3, 3), (40, 2)])
def test_runs_of_small_alphabets(least, times):
    draw = random.Random(least)
    for _ in range(150):
        docs = []
        for _ in range(draw.randint(0, 6)):
            doc = []
            while draw.random() < 0.8:
                unit = [draw.randrange(draw.randint(1, 4)) for _ in range(draw.randint(1, 7))]
                doc += (unit * draw.randint(1, 8))[: draw.randint(1, 45)]
            docs.append(doc)
        bounds = np.cumsum([0, *map(len, docs)])
        start, length, period = runs.word_runs(np.array([x for d in docs for x in d], np.int32), bounds, least, times)
        want = [(s + bounds[i], n, p) for i, d in enumerate(docs) for s, n, p in brute(d, least, times)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_extensions_are_the_words_in_common():
    draw = np.random.default_rng(3)
    ids, ends = draw.integers(0, 2, 300), np.repeat([100, 300], [100, 200])
    found = runs.Extensions(ids, ends)
    for a in range(0, 300, 7):
        for b in range(a + 1, int(ends[a]), 5):
            n = next((k for k in range(ends[a] - b) if ids[a + k] != ids[b + k]), ends[a] - b)
            assert found.query(np.array([a]), np.array([b]))[0] == n


def test_odd_rows(spark):
    texts = [None, "", "   ", "a a a a a a", "a a a a a", "a b a b a b a b c c c c c c", "x " * 3000, "é ü é ü\té ü\n\né ü", "w" * 100_000, "a\x0bb a b a b a b"]
    rows = [(i % 4 or None, t, "s") for i, t in enumerate(texts * 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").withColumnRenamed("start", "n_runs")
    out = runs.periodic_runs(docs.repartition(3))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs", "collapsed"]
    got = sorted((r.doc_id or 0, r.collapsed, [tuple(x) for x in r.runs], r.exponent_milli or 0) for r in out.collect())
    want = []
    for i, t, _ in rows:
        words = (t or "").split()
        e = expected(i, words)
        want.append((i or 0, collapsed(words, brute(words)), brute(words), e["exponent_milli"] or 0))
    assert got == sorted(want)
    assert runs.periodic_runs(docs.limit(0)).collect() == []


def test_query(spark, tmp_path):
    """The registered query over words in a small alphabet, with its edit by hash of doc_id."""
    draw = random.Random(8)
    rows = [(i, None if i % 29 == 0 else " ".join(draw.choice("abc") if draw.random() < 0.5 else f"w{draw.randrange(40)}" for _ in range(draw.randint(0, 60)))) for i in range(1000)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.asDict() for r in registry.op13_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, n)]
        assert got[i] == expected(i, words)
    assert sum(r["n_runs"] for r in got.values()) > 20
