"""Near copies against brute force where buckets stay open after the stars, ids repeat or are null, and joins are not broadcast."""

import itertools
import random

import numpy as np
import pytest

from tesserine.llm import neardup, shared

SCHEMA = "doc_id long, text string, cid string"


def rows():
    """Families around one base text: members differ from it by less or more than the limit, and some from each other by less."""
    rnd = random.Random(9)
    out, i = [], 0
    for f in range(6):
        base = [f"f{f}w{k}" for k in range(120)]
        for branch in range(5):
            words = list(base)
            for k in rnd.sample(range(0, 120, 6), 4):  # about 0.7 from the base and from other branches
                words[k] = f"b{branch}x{k}"
            for _ in range(4):
                i += 1
                member = [*words, *(f"t{i}n{k}" for k in range(rnd.randint(0, 14)))]
                out.append((i * 7 % 131, " ".join(member)))
    out += [(None, out[0][1]), (None, out[5][1]), (None, "alone with no id at all here"), (3, out[7][1]), (3, "other text of the same id three"), out[9], out[9], (500, "a b"), (501, "A  b"), (502, None), (502, " ")]
    return out


def brute(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a, b in itertools.combinations(range(len(rows)), 2):
        common = len(sets[a] & sets[b])
        if sets[a] and group[a] != group[b] and 100 * common >= percent * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    return sorted((str(i), len(s), str(least.get(g) if s else i)) for g, (i, _), s in zip(group, rows, sets, strict=True))


@pytest.mark.parametrize("options", [{"percent": 85}, {"percent": 85, "block_bytes": 4000}, {"percent": 80, "bands": 38, "rows": 5, "block_bytes": 4000}], ids=str)
def test_open_buckets(spark, options, monkeypatch):
    links = []
    across = neardup._across
    monkeypatch.setattr(neardup, "_across", lambda *a: (links.append(a), across(*a))[1])
    if "block_bytes" in options:
        monkeypatch.setattr(shared, "BROADCAST_ROWS", 0)  # the joins of large inputs
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows()], SCHEMA).repartition(4)
    got = neardup.near_duplicates(docs, **options).collect()
    assert links, "no bucket stayed open"
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute(rows(), options["percent"])


def test_a_refused_pair_unites_nothing():
    """A and B share a component with C only through C; the test of A and B comes first and must not hide A and C."""
    pool = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 200, dtype=np.uint64))
    a, b, c = pool[:100], pool[10:110], np.sort(np.concatenate((pool[:96], pool[100:104])))
    regs = neardup.registers(a, 192).tobytes()
    table = neardup.pa.table({"cid": [b"a", b"b", b"c"], "comp": [b"a", b"b", b"c"], "n": [100] * 3, "side": [2] * 3, "band": [0] * 3, "regs": [regs] * 3, "elements": [x.tobytes() for x in (a, b, c)]})
    assert neardup._across(0.85, 85, 6)(table).to_pylist() == [{"a": b"a", "b": b"c"}]


def test_many_copies(spark):
    """Classes beyond the limit are placed by a broadcast, with the same result."""
    rows_ = spark.createDataFrame([(i, b"k" if i % 3 else b"l" if i else None) for i in range(30)], "doc_id long, set_key binary")
    found = spark.createDataFrame([(b"k", 20, 1), (b"l", 9, 3)], "cid binary, copies long, component long")
    got = [{(r.doc_id, r.component) for r in neardup._placed(rows_, found, many).collect()} for many in (10, 100)]
    assert got[0] == got[1] and len(got[0]) == 30 and (0, None) in got[0]
