"""The pipeline's near-dedup stage row by row."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def near_dedup(spark, rows):
    docs = spark.createDataFrame([(i, t, "a", s, len(t or "")) for i, t, s in rows], SCHEMA).repartition(3)
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == list(corpus_pipeline.COLUMNS)
    return sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)


def text(name, n=100):
    return " ".join(f"{name}{k}" for k in range(n))


def test_pairs_from_080_are_copies(spark):
    # 96 shingles each; a changed tail of k words leaves 96 - k of them: Jaccard (96 - k) / (96 + k).
    tail = lambda name, k: " ".join([*text(name).split()[: 100 - k], *(f"new{j}" for j in range(k))])
    rows = [(1, text("a"), "s"), (2, tail("a", 9), "s"), (3, text("b"), "s"), (4, tail("b", 11), "s")]  # 0.829 and 0.794
    assert [r[0] for r in near_dedup(spark, rows)] == [1, 3, 4]


def test_one_row_of_each_group_whatever_its_id(spark):
    none, twice, other, empty = text("a"), text("b"), text("c"), text("d")
    rows = [(None, none, "s"), (None, none + " end", "s"), (None, none, None)]  # copies without an id
    rows += [(7, twice, "s"), (7, twice, "s"), (7, twice, "t"), (None, twice, "s")]  # a repeated row, and the same text from elsewhere
    rows += [(1, other, "s"), (2, other + " end", "s"), (2, empty, "s")]  # id 2 is a copy and a text of its own
    rows += [(9, " ", "s"), (9, " ", "s"), (None, None, "s")]  # no word
    got = near_dedup(spark, rows)
    assert len([r for r in got if r[1] in (none, none + " end")]) == 1
    assert [r[:2] for r in got if r[1] == twice] == [(7, twice)]
    assert (1, other, "s") in got and (2, empty, "s") in got and (2, other + " end", "s") not in got
    assert got.count((9, " ", "s")) == 2 and (None, None, "s") in got and len(got) == 7
