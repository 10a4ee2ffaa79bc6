"""Mixing over repeated, null and clashing rows, and its salted join against its broadcast."""

from collections import Counter

from tesserine.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string, copies string"


def rows():
    out = [(i, "w " * (i % 40), f"s{i % 7}" if i % 11 else None) for i in range(400)]
    return out + [(None, "a b", "s1"), (None, None, None), (3, "other words", "s3"), out[5], out[5], (900, "one", "alone"), (901, "", "empty"), (902, "x", "")]


def test_salted_join_and_clashing_columns(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows()], SCHEMA).repartition(3)
    columns = ("doc_id", "source", "size", "source_size", "target", "copies")
    one = Counter(map(tuple, mixing.with_copies(docs).select(*columns).collect()))
    mixed = Counter(map(tuple, mixing.mix(docs).collect()))
    assert all(r[3:] == ("x", "y", "z") for r in mixed)
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    assert Counter(map(tuple, mixing.with_copies(docs).select(*columns).collect())) == one
    assert Counter(map(tuple, mixing.mix(docs).collect())) == mixed
    assert sum(mixed.values()) == sum(r[5] * n for r, n in one.items())
    copies = {r[:3]: r[5] for r in one}
    assert copies[901, "empty", 0] == 0 and copies[None, None, 0] in (0, 1, 2)


def test_taken_words_come_near_targets(spark):
    """With many documents a source, the words taken come within a tenth of the target; no document is taken over twice."""
    docs = spark.createDataFrame([(i, "w " * (1 + i % 9), f"s{i % 3}") for i in range(6000)], "doc_id long, text string, source string")
    got = mixing.with_copies(docs).collect()
    taken = Counter()
    for r in got:
        taken[r.source] += r.copies * r["size"]
        assert r.copies <= 2
    assert all(abs(taken[r.source] / r.target - 1) < 0.1 for r in got)
