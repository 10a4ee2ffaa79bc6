"""The parse against brute force where ids repeat or are null, texts are cut, blocks are split, and hashes collide."""

import hashlib
import random

import numpy as np
import pytest

from tesserine.llm import substrings

SCHEMA = "doc_id long, text string, kept string, row string"


def rows():
    rnd = random.Random(5)
    words = [f"v{i}" for i in range(40)] + ["é", "日本", "x" * 400]
    some = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    p, q, shared = some(60), some(40), some(30)
    out = [(1, p), (5, p + " tail"), (5, q), (5, q), (None, some(20) + " " + shared), (None, q + "\t" + shared), (7, None), (8, ""), (9, " ".join(["a"] * 80)), (10, " ".join(["a"] * 50)), (11, " \n".join((shared + " " + p).split())), (12, some(12)), (12, some(13))]
    out += [(i, some(rnd.randint(0, 30)) + " " + shared + " " + some(rnd.randint(0, 200))) for i in range(20, 60)]
    return out + [(3, out[-1][1]), (70, "b " + out[-3][1].replace(" ", "  ")), (70, "x" * 400 + " " + p)]


def brute(rows, window=13):
    low = lambda i: -(1 << 63) if i is None else i
    least, want = {}, []
    runs = lambda w: [tuple(w[k : k + window]) for k in range(len(w) - window + 1)]
    for i, t in rows:
        for g in runs((t or "").split()):
            least[g] = min(low(i), least.get(g, 1 << 62))
    for i, t in rows:
        w = (t or "").split()
        gone = {k + j for k, g in enumerate(runs(w)) if least[g] < low(i) for j in range(window)}
        left = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((str(i), len(w), len(gone), left if gone else t))
    return sorted(want, key=str)


@pytest.mark.parametrize("options", [{}, {"block_bytes": 40, "piece_bytes": 120, "share": 1.0}], ids=["as it is", "cut texts and split blocks"])
def test_rows_of_one_id_are_cut_apart(spark, options):
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows()], SCHEMA).repartition(4)
    got = substrings.substring_dedup(docs, **options)
    assert got.columns == ["doc_id", "row", "n_words", "n_removed", "kept"]
    assert sorted([(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == brute(rows())
    hashed = {(str(r.doc_id), r.kept) for r in substrings.substring_dedup(docs, texts=False, **options).collect()}
    assert hashed == {(i, hashlib.sha256(" ".join((k or "").split()).encode()).hexdigest()) for i, _, _, k in brute(rows())}


def test_phrases_name_their_reference(spark):
    texts = [(i, t or "") for i, t in rows() if i is not None and i != 5 and i != 12 and i != 70]
    docs = spark.createDataFrame([(i, 0, t) for i, t in texts], "doc_id long, row long, text string")
    words = {i: t.split() for i, t in texts}
    found = substrings.phrases(docs).collect()
    assert found
    for r in found:
        n = r.n + 12
        assert r.ref_doc < r.doc_id and words[r.doc_id][r.start : r.start + n] == words[r.ref_doc][r.ref_start : r.ref_start + n]


def test_equality_is_by_words(monkeypatch):
    monkeypatch.setattr(substrings, "grams", lambda hashes, n: np.zeros(max(0, len(hashes) - n + 1), np.uint64))  # every window collides
    text = b"a b c d a b x y a b c d "
    one = np.array([0, 1, 2])
    p = substrings.Passages(text, one, one, np.zeros(3, np.int64), np.full(3, 4), 3)
    assert p.first_equal().tolist() == [0, 1, 2, 3, 0, 1]
    settled, found = p.phrases(p.first_equal())
    assert settled.tolist() == [False] * 4 + [True] * 2 and [x.tolist() for x in found] == [[2], [2], [0], [2], [0], [0]]


def test_extra_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, t, 1, 2, 3, 4) for i, t in rows()], "doc_id long, text string, __found int, __text int, Key int, found_key int")
    got = substrings.substring_dedup(docs)
    assert got.columns == ["doc_id", "__found", "__text", "Key", "found_key", "n_words", "n_removed", "kept"]
    assert sorted([(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == brute(rows())


def test_rows_of_null_id(spark):
    """Copies of one text, and one passage in many different texts, all of null id; then documents that hold the passage too."""
    draw = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(40))
    some = lambda n: " ".join(f"w{draw.randrange(3000)}" for _ in range(n))
    data = [(4, passage + " once " + passage), (2, some(5))] + [(7, f"{some(3)} {passage} {some(4)} {passage} x") for _ in range(200)] + [(None, "same row " + some(30))] * 20_000
    data += [(i, some(9) + " " + passage) for i in range(20, 40)]
    expected = brute(data)
    for options in ({}, {"block_bytes": 300, "piece_bytes": 2000, "share": 1.0}):
        got = substrings.substring_dedup(spark.createDataFrame(data, "doc_id long, text string").repartition(6), **options)
        assert sorted([(str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()], key=str) == expected


def test_phrases_go_on_with_their_reference():
    """The second half of the reference also stands in an earlier document: the phrase isn't cut there."""
    a = [f"a{i}" for i in range(40)]
    docs = [a[20:] + ["x"], a + ["y"], ["z", *a, "q"]]
    number = np.arange(3)
    text = "".join(w + " " for d in docs for w in d).encode()
    p = substrings.Passages(text, number, number, np.zeros(3, np.int64), np.array([len(d) for d in docs]), 13)
    first = p.first_equal()
    settled, (doc, _, start, n, ref, ref_start) = p.phrases(first)
    assert list(zip(doc.tolist(), start.tolist(), n.tolist(), ref.tolist(), ref_start.tolist(), strict=True)) == [(1, 20, 8, 0, 0), (2, 1, 28, 1, 0)]
    assert settled.sum() == 8 + 28
