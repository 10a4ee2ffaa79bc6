"""The stored vector index: exact over all lists, measured over few, pruned on disk."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tesserine.operators import ann, postings

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = np.random.default_rng(5)
    centre = draw.normal(size=(20, 16)) * 3
    x = (centre[draw.integers(0, 20, 3000)] + draw.normal(size=(3000, 16))).astype(np.float32)
    x[1000:1400] = x[1000]  # a third of nothing, but a hot list
    rows = [(i, [float(v) for v in row], i % 4) for i, row in enumerate(x)]
    odd = [(5000, None, 1), (5001, [], 1), (5002, [1.0], 1), (5003, [float("nan")] * 16, 1), (5004, [None] * 16, 1)]
    path = str(tmp_path_factory.mktemp("ann"))
    ann.build(spark.createDataFrame(rows + odd, SCHEMA).repartition(4), path, keep=["label"], lists=30)
    return x.astype(np.float64), ann.VectorIndex(spark, path)


def exact(x, query, k, keep=None, skip=None):
    score = np.round(x @ np.array(query), 6)
    ids = [i for i in range(len(x)) if (keep is None or keep(i)) and i != skip]
    return sorted(ids, key=lambda i: (-score[i], i))[:k]


def test_all_lists_are_exact(spark, stored):
    x, index = stored
    assert index.lists.count() == 3000 and len(index.means) == 30
    q = x[7]
    assert [r.key for r in index.near(q.tolist(), 20, 30).orderBy("rank").collect()] == exact(x, q, 20)
    assert [r.key for r in index.near(q.tolist(), 20, 30, F.col("label") == 3).orderBy("rank").collect()] == exact(x, q, 20, lambda i: i % 4 == 3)
    asked = [(i, [float(v) for v in x[i]]) for i in (0, 5, 1000, 1200)] + [(-1, None), (-2, [1.0])]
    got = index.search(spark.createDataFrame(asked, "query_id long, vector array<double>"), 5, 30, skip_self=True).collect()
    for i in (0, 5, 1000, 1200):
        assert [r.key for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == exact(x, x[i], 5, skip=i)
    assert {r.query_id for r in got} == {0, 5, 1000, 1200}


def test_small_pieces_and_blocks(spark, stored, monkeypatch):
    x, index = stored
    monkeypatch.setattr(ann, "PIECE", 50)
    monkeypatch.setattr(ann, "BLOCK", 3)
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 3000, 100)], "query_id long, vector array<double>")
    got = index.search(asked, 7, 30).collect()
    for i in range(0, 3000, 100):
        assert [r.key for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == i] == exact(x, x[i], 7)


def test_recall_and_calibration(spark, stored):
    x, index = stored
    asked = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(0, 3000, 50)], "query_id long, vector array<double>")
    probes = index.calibrate(asked, 10, 0.95)
    assert probes < 15, "clusters are found in few lists"
    measured = ann.recall(index.search(asked, 10, probes), index.search(asked, 10, 30)).first()
    assert measured.queries == 60 and measured.recall >= 0.9


def test_lists_are_pruned(spark, stored):
    x, index = stored
    plan = index.near(x[0].tolist(), 5, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shelf" in plan.replace("shelf#", "shelf") or "PartitionFilters: [shelf" in plan and "PushedFilters: [In(list" in plan
    assert not any(s in plan for s in ("Python", "Arrow", "Pandas"))


def test_empty_table(spark, tmp_path):
    ann.build(spark.createDataFrame([(1, None, 1)], SCHEMA), str(tmp_path))
    index = ann.VectorIndex(spark, str(tmp_path))
    assert index.near([1.0], 3).collect() == [] and index.search(spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>"), 3).collect() == []


def test_postings_of_rows(spark, tmp_path):
    texts = [(1, "a b a"), (2, None), (3, ""), (4, "B_1 é a"), (5, "x " * 500)]
    docs = spark.createDataFrame(texts, "id long, text string")
    postings.build(docs, "id", {"text": F.col("text"), "upper": F.upper("text")}, str(tmp_path), 4)
    held = {(r.field, r.term, r.key): (r.tf, r.dl, r.positions, r.bucket) for r in spark.read.parquet(f"{tmp_path}/postings").collect()}
    assert held["text", "a", 1][:3] == (2, 3, [0, 2]) and held["text", "b_1", 4][:3] == (1, 2, [0]) and held["upper", "x", 5][0] == 500 and len(held) == 2 * 5
    assert all(b == postings.bucket_of(term, 4) for (_, term, _), (_, _, _, b) in held.items())
    words = ["", "a", "license", "é", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(postings._bucket(F.col("w"), 64)).collect()
    assert [r[0] for r in got] == [postings.bucket_of(w, 64) for w in words]


def test_blocks_hold_a_term_once():
    """What the build shuffles: a row a term of a block, not a posting; tokens end with their row, and a text over the block's bytes is a block of its own."""
    keys, texts = [3, 1, 2, 9], ["a b a", "a", "", "é_x b" + " b" * 40]
    rows = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(texts)], ["key", "f0"])
    whole = pa.Table.from_batches(list(postings._blocks(["t"], 1 << 20)([rows, rows.slice(1, 0)]))).to_pylist()
    place = lambda key, dl, *at: {"key": key, "dl": dl, "tf": len(at), "positions": list(at)}
    assert {r["term"]: r["rows"] for r in whole} == {"a": [place(3, 3, 0, 2), place(1, 1, 0)], "b": [place(3, 3, 1), place(9, 42, *range(1, 42))], "_x": [place(9, 42, 0)]}
    parts = pa.Table.from_batches(list(postings._blocks(["t"], 6)([rows.slice(0, 2), rows.slice(2)]))).to_pylist()
    assert [(r["term"], [p["key"] for p in r["rows"]]) for r in parts] == [("a", [3, 1]), ("b", [3]), ("_x", [9]), ("b", [9])]
    codes = np.array([70000, 3, 65539, 3, 70000, 0])
    assert postings._by_code(codes).tolist() == np.argsort(codes, kind="stable").tolist()
