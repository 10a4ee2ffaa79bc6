"""Sharding against its law: exact sizes, near equal sums, equal texts together, heavy ones split, all rows numbered."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tesserine.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string"


def rows():
    rnd = random.Random(2)
    out = [(i, "".join(rnd.choice("abc é") for _ in range(rnd.randint(0, 300)))) for i in range(3000)]
    out += [(None, "no id"), (None, None), (5, "again"), (5, "again"), (6, None)]
    out += [(10_000 + i, "heavy " * 40) for i in range(600)]  # over a 64th of a shard by bytes
    return out + [(20_000 + i, "tiny") for i in range(300)]  # many rows, few bytes


@pytest.mark.parametrize("limit", [100_000, 50], ids=["as it is", "many tasks"])
def test_law_holds(spark, limit):
    data = rows()
    got = sharding.shard(spark.createDataFrame([(*r, "x", "x") for r in data], SCHEMA).repartition(4), shards=8, row_limit=limit).collect()
    count = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((str(r.doc_id), r["size"], r.text_crc32) for r in got) == Counter(count(*r) for r in data)
    load, places, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        load[r["shard"]] += r["size"]
        places[r["size"], r.text_crc32].add(r["shard"])
        slots[r["shard"]].append(r.slot)
    total = sum(load.values())
    assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) <= total / 8 / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weight = Counter()
    for _, t in data:
        weight[len((t or "").encode()) + 1, zlib.crc32((t or "").encode())] += len((t or "").encode()) + 1
    assert all(len(where) == 1 for text, where in places.items() if weight[text] <= total // 512)
    assert len(places[241, zlib.crc32(b"heavy " * 40)]) > 1, "a text heavier than a shard's share must part"


def test_reruns_agree(spark):
    docs = spark.createDataFrame([(*r, "x", "x") for r in rows()[:500]], SCHEMA)
    one, two = (sorted(map(str, sharding.shard(docs.repartition(n)).collect())) for n in (2, 5))
    assert one == two


def test_equal_rows_are_dealt_by_ordinal(spark):
    """One row that repeats until it holds four fifths of all bytes, with a null id, and many cheap copies of another."""
    data = [(None, "r" * 99)] * 5000 + [(i, "t" * (i % 60)) for i in range(1500)] + [(8, None)] * 3000
    docs = spark.createDataFrame(data, "doc_id long, text string")
    for parts, limit in ((3, 100_000), (7, 200)):
        got = sharding.shard(docs.repartition(parts), row_limit=limit).collect()
        load, slots = Counter(), defaultdict(list)
        for r in got:
            load[r["shard"]] += r["size"]
            slots[r["shard"]].append(r.slot)
        assert len(got) == len(data) and sum(r["size"] == 100 for r in got) >= 5000
        assert sorted(load) == list(range(8)) and max(load.values()) - min(load.values()) <= sum(load.values()) / 8 / 16
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    one, two = (sorted(map(str, sharding.shard(docs.repartition(n)).collect())) for n in (2, 5))
    assert one == two
