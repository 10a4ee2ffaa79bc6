"""Many questions in one plan against one question at a time; functions in SQL text against their DataFrame forms."""

import random

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tesserine.functions import chunkers
from tesserine.operators import ann, batch, postings
from tesserine.plans import surface


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    draw = random.Random(8)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(draw.choice(words) for _ in range(draw.randint(0, 30))), draw.choice(words), [draw.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    docs = spark.createDataFrame([*rows, (500, None, None, None)], "id long, text string, head string, vector array<double>")
    path = str(tmp_path_factory.mktemp("batch"))
    postings.build(docs, "id", {"text": F.col("text"), "head": F.col("head")}, f"{path}/words", 4)
    ann.build(docs, f"{path}/vectors", "id", "vector", lists=5)
    return docs, postings.Index(spark, f"{path}/words"), ann.VectorIndex(spark, f"{path}/vectors")


FIELDS = {"text": 1.0, "head": 2.5, "absent": 9.0}
ASKED = [(1, "w1 W2 w2"), (2, "w3"), (3, None), (4, "nothing here"), (5, "w1 w4 w9 w24")]


def test_matches_are_those_of_single_questions(spark, stored):
    _, index, _ = stored
    got = batch.matches(index, spark.createDataFrame(ASKED, "query int, text string"), FIELDS).collect()
    for query, text in ASKED:
        fields = {f: b for f, b in FIELDS.items() if f in index.stats}
        want = {r.key: r.score for r in postings.search(should=[index.best_fields(fields, text or "")]).collect()}
        assert {r.key: r.score for r in got if r.query == query} == pytest.approx(want, abs=2e-6)
    assert batch.matches(index, spark.createDataFrame(ASKED, "query int, text string"), {"absent": 1.0}).collect() == []


def test_pool_and_rerank(spark, stored):
    docs, index, vectors = stored
    asked = spark.createDataFrame([(*a, [1.0, 0.0, 0.0, 0.0, 0.0, float(a[0])] if a[0] != 5 else None) for a in ASKED], "query int, text string, vector array<double>")
    pool = batch.retrieve(asked, index, FIELDS, vectors, pool=30).collect()
    for query, text in ASKED:
        words = sorted(batch.matches(index, asked.where(F.col("query") == query), FIELDS).collect(), key=lambda r: (-r.score, r.key))
        near = vectors.near([1.0, 0.0, 0.0, 0.0, 0.0, float(query)], batch.KNN, 5).orderBy("rank").collect() if query != 5 else []
        score = {}
        for hits in (words, near):
            for rank, r in enumerate(hits, 1):
                score[r.key] = score.get(r.key, 0) + 1 / (60 + rank)
        want = sorted(((-round(s, 9), k) for k, s in score.items()))[:30]
        assert [(r.key, r["rank"]) for r in sorted(pool, key=lambda r: r["rank"]) if r.query == query] == [(k, i) for i, (_, k) in enumerate(want, 1)]
    some = spark.createDataFrame([(q, k) for q in (1, 2) for k in range(10)], "query int, key long")
    few = batch.retrieve(asked, index, FIELDS, vectors, allowed=some).collect()
    assert few and {(r.query, r.key) for r in few} <= {(q, k) for q in (1, 2) for k in range(10)}

    hits = batch.retrieve(asked, index, FIELDS, vectors, pool=30)
    texts = docs.select(F.col("id").alias("key"), F.col("text").alias("pair_text")).crossJoin(asked.select("query"))
    got = batch.fused_and_reranked(hits, texts, lambda: lambda pairs: [float(len(p)) for p in pairs], k=4, reranked=10).collect()
    length = {r.id: len(r.text or "") for r in docs.collect()}
    for query in (1, 2, 4):
        first = [r for r in sorted(pool, key=lambda r: r["rank"]) if r.query == query][:10]
        want = sorted(first, key=lambda r: (-length[r.key], r["rank"]))[:4]
        assert [r.key for r in sorted(got, key=lambda r: r.rerank_rank) if r.query == query] == [r.key for r in want]
    assert [r.key for r in batch.fused_and_reranked(hits, texts, None, k=3).where("query = 1").orderBy("rerank_rank").collect()] == [r.key for r in sorted(pool, key=lambda r: r["rank"]) if r.query == 1][:3]


def test_sql_surface(spark):
    surface.register(spark)
    go = "package p\n\nfunc A() {\n\ta()\n}\n\ntype T struct{}\n"
    spark.createDataFrame([(1, go, "go"), (2, None, "go"), (3, "x", None)], "id int, text string, ext string").createOrReplaceTempView("sources")
    cut = spark.sql("SELECT id, c.* FROM sources, LATERAL code_chunks(text, ext) c").collect()
    assert [tuple(r)[1:] for r in cut if r.id == 1] == chunkers.chunk_lines(go, "go") and {r.id for r in cut} == {1, 3}
    packed = spark.sql("SELECT c.* FROM sources, LATERAL code_chunks(text, ext, 12) c WHERE id = 1").collect()
    assert [tuple(r) for r in packed] == chunkers.packed_chunks(go, "go", 12)
    assert [(r.kind, r.name, r.start_line) for r in spark.sql("SELECT d.* FROM sources, LATERAL go_declarations(text) d").collect()] == [("function", "A", 3), ("type", "T", 7)]
    assert spark.sql("SELECT tokens('A-b c_1'), inner_product(array(1D, 2D), array(3D, 4D)), lines_of('a\nb\nc', 2, 3), go_package('package x\n'), rank_share(1, 60)").first()[:] == (["a", "b", "c_1"], 11.0, "b\nc", "x", 1 / 61)
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM code_chunks(1, 'go')").collect()
    with pytest.raises(AnalysisException):
        spark.sql("SELECT * FROM code_chunks('a', 'go', -1)").collect()


def test_most_hands_on_few_rows(spark, stored, monkeypatch):
    """With ``most`` a task keeps the best of each question, ties to the smaller key, however few scores it holds at a time; beyond ASKED words the join is a shuffle with the same rows."""
    _, index, _ = stored
    asked = spark.createDataFrame([*ASKED, (6, "w3 w5"), (None, "w7")], "query int, text string")
    rows = lambda df: sorted((r.query or 0, r.key, r.score) for r in df.collect())
    whole = batch.matches(index, asked, FIELDS)
    everything, want = rows(whole), rows(batch.best(whole, 7))
    for held in (1, 50, 1 << 20):
        monkeypatch.setattr(batch, "ROWS", held)
        assert rows(batch.matches(index, asked, FIELDS)) == everything
        few = batch.matches(index, asked, FIELDS, most=7)
        assert rows(batch.best(few, 7)) == want and few.count() < len(everything)
    monkeypatch.setattr(batch, "ASKED", 0)
    assert rows(batch.matches(index, asked, FIELDS)) == everything
    assert batch.matches(index, asked.where("query = 3"), FIELDS).collect() == []


def test_a_pool_is_found_once(spark):
    """The reranked query reads its pool twice, and its plan finds it no time: it was written."""
    from tesserine.queries import batches

    plan = batches.batch_reranked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "MapInArrow" not in plan and plan.count("pool-") in (0, 2)


def _tables(spark, folder):
    """Documents of which the second holds only the last word of a question of eight words, with no vectors near."""
    rows = {"documents": ("doc_id long, text string, source string, lang string", [(1, "one two", "a", "en"), (2, "eight", "b", "en"), (3, "none of them", "c", "en")]), "benchmark": ("item_id long, text string", [(7, "one x2 x3 x4 x5 x6 x7\neight"), (8, None)])}
    rows["embeddings"] = ("vec_id long, embedding array<float>, label int", [(1, [1.0, 0.0], 0)])
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_a_question_is_taken_whole(spark, tmp_path):
    from tesserine.queries import batches

    got = batches.batch_hybrid(spark, _tables(spark, tmp_path)).collect()
    assert {(r.query, r.key) for r in got} == {(7, 1), (7, 2)}


def test_a_reranked_question_is_taken_whole(spark, tmp_path):
    from tesserine.queries import batches

    got = batches.batch_reranked(spark, _tables(spark, tmp_path)).collect()
    assert {(r.query, r.key, r.rerank_score) for r in got} == {(7, 1, 7.0), (7, 2, 5.0)}
