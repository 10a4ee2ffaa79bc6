"""Queries of many questions in one plan and in SQL text, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.operators import batch, rag
from tesserine.plans import surface
from tesserine.plans.staging import staged
from tesserine.queries.indexes import _UNIT, go_files, vector_index
from tesserine.queries.registry import _TOK, index_of, query, table

#: Benchmark items are the questions: their texts or first words, and the vector of the same number.
_FIELDS = {"text": 1.0, "source": 2.0}
_WORDS = "array_to_string(string_split(coalesce(text, ''), ' ')[1:5], ' ')"
_WHOLE = "coalesce(text, '')"
_POSTED = " UNION ALL ".join(f"SELECT '{f}' AS field, {b}::DOUBLE AS boost, doc_id, {_TOK.format(f'coalesce({f}, chr(0))')} AS t FROM documents" for f, b in _FIELDS.items())


def _matched(asked: str) -> str:
    return f"""SELECT query, doc_id AS key, round(max(score), 6) AS score FROM (
  SELECT query, doc_id, p.field, any_value(boost) * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))) AS score
  FROM (SELECT DISTINCT item_id AS query, unnest({_TOK.format(asked)}) AS term FROM benchmark) q
  JOIN (SELECT field, any_value(boost) AS boost, doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT field, boost, doc_id, unnest(t) AS term, len(t) AS dl FROM ({_POSTED})) GROUP BY field, doc_id, term) p USING (term)
  JOIN (SELECT field, term, count(*) AS df FROM (SELECT DISTINCT field, doc_id, unnest(t) AS term FROM ({_POSTED})) GROUP BY 1, 2) d ON p.field = d.field AND p.term = d.term
  JOIN (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM ({_POSTED}) GROUP BY field) s ON p.field = s.field GROUP BY query, doc_id, p.field) GROUP BY query, doc_id"""


def _ranked(rows: str, k: int) -> str:
    return f"SELECT * FROM (SELECT query, key, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, key)::INT AS rank FROM ({rows})) WHERE rank <= {k}"


_NEAR = "SELECT b.item_id AS query, e.vec_id AS key, round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM benchmark b JOIN embeddings q ON b.item_id = q.vec_id CROSS JOIN embeddings e"


def _pool(asked: str) -> str:
    return _ranked(f"SELECT query, key, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM ({_ranked(_matched(asked), 300)} UNION ALL {_ranked(_NEAR, 50)}) GROUP BY query, key", 200)


def _questions(spark, sf_dir, whole=False):
    """The questions: ``whole`` texts, or the five words that some queries' SQL asks for."""
    items = table(spark, sf_dir, "benchmark")
    text = F.coalesce("text", F.lit(""))
    words = text if whole else F.array_join(F.slice(F.split(text, " ", -1), 1, 5), " ")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return items.join(vectors, "item_id", "left").select(F.col("item_id").alias("query"), words.alias("text"), "vector")


@query(_ranked(_matched(_WORDS), 300))
def batch_bm25(spark, sf_dir):
    """The lexical candidates of every question, in one plan."""
    return batch.best(batch.matches(index_of(spark, sf_dir), _questions(spark, sf_dir), _FIELDS, most=300), 300)


@query(_pool(_WHOLE))
def batch_hybrid(spark, sf_dir):
    """The fused pool of every question, taken whole: BM25 and vectors."""
    return batch.retrieve(_questions(spark, sf_dir, whole=True), index_of(spark, sf_dir), _FIELDS, vector_index(spark, sf_dir))


def _by_length():
    """A stand-in for a cross-encoder."""
    return lambda texts: [float(len(t) % 17) for t in texts]


@query(f"""SELECT query, key, score, rank, rerank_score, rerank_rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC NULLS LAST, rank, key)::INT AS rerank_rank
  FROM (SELECT p.query, p.key, score, rank, CASE WHEN rank <= 60 THEN (length(coalesce(text, '')) % 17)::DOUBLE END AS rerank_score FROM ({_pool(_WHOLE)}) p LEFT JOIN documents d ON p.key = d.doc_id)) WHERE rerank_rank <= 10""")
def batch_reranked(spark, sf_dir):
    """The ten best of every question, taken whole, after its first sixty fused hits are reranked."""
    hits = staged(batch.retrieve(_questions(spark, sf_dir, whole=True), index_of(spark, sf_dir), _FIELDS, vector_index(spark, sf_dir)), "pool")  # read twice
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("pair_text"))
    return batch.fused_and_reranked(hits, hits.select("query", "key").join(docs, "key"), _by_length)


def _rates():
    """A stand-in for the filter's model: four for every document, but one for those whose number ends in 0 to 6."""
    import json
    import re

    return lambda prompts: [json.dumps({"score": 4 if int(re.search(r"File: d(\d+):", p)[1]) % 10 > 6 else 1, "why": "its number"}) for p in prompts]


def _answers():
    """A stand-in for the answering model: whether it was shown evidence, with a citation."""
    return lambda prompts: [f"{p.count('[1]') > 0} [1]" for p in prompts]


@query(f"""WITH p AS (SELECT * FROM ({_pool(_WORDS)}) JOIN (SELECT doc_id AS key FROM documents) USING (key)), r AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY rank)::INT AS rank FROM p),
  c AS (SELECT query, count(*) AS recalled, count_if(key % 10 > 6) AS good FROM r WHERE rank <= 100 GROUP BY query)
  SELECT item_id AS query, coalesce(recalled, 0) AS recalled, (CASE WHEN good >= 8 THEN good ELSE coalesce(recalled, 0) END)::BIGINT AS kept, CASE WHEN recalled > 0 THEN 'True [1]' ELSE 'No relevant chunks found to answer your question.' END AS answer, coalesce(least(8, recalled), 0)::INT AS evidence FROM benchmark LEFT JOIN c ON item_id = query""")
def answer_plan(spark, sf_dir):
    """Recall, filter, rerank, evidence and answer of every question in one plan, with stand-ins for the models. Fewer than eight good rows relax the threshold until all stay."""
    questions = _questions(spark, sf_dir)
    hits = staged(batch.retrieve(questions, index_of(spark, sf_dir), _FIELDS, vector_index(spark, sf_dir)), "pool")  # its size decides how texts are met
    none = F.lit(None).cast("string")
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("key"), F.coalesce("source", F.lit("none")).alias("repo_id"), F.concat(F.lit("d"), "doc_id").alias("rel_path"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), F.col("lang").alias("language"),
        F.coalesce("text", F.lit("")).alias("text"), none.alias("summary_en"), none.alias("chunk_hash"), none.alias("primary_symbol"), none.alias("primary_kind"), F.array().cast("array<string>").alias("all_roles"),
    )
    recalled = batch.best(hits.withColumn("score", -F.col("rank")).drop("rank").join(docs, "key"), 100).withColumnRenamed("key", "id").withColumn("retriever_score", F.col("score").cast("double")).drop("score")
    out = rag.answered(questions.select("query", F.col("text").alias("question")), recalled, _rates, _by_length, _answers)
    items = F.regexp_count(F.coalesce("evidence", F.lit("")), F.lit(r"(?m)^\[\d+\]"))
    return out.select("query", "recalled", "kept", "answer", items.alias("evidence"))


# SQL text ----------------------------------------------------------------------------------


@query(f"""WITH f AS (SELECT lang, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9_]+'), lambda t: length(t) > 0) AS t, text FROM documents)
  SELECT coalesce(lang, '') AS lang, count(*) AS n, sum(len(t))::BIGINT AS tokens, sum(length(array_to_string(string_split(text, chr(10))[1:2], chr(10))))::BIGINT AS heads FROM f GROUP BY 1""")
def sql_functions(spark, sf_dir):
    """Tokens and lines by functions that SQL text calls."""
    surface.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("sql_documents")
    return spark.sql("SELECT coalesce(lang, '') AS lang, count(*) AS n, sum(size(tokens(coalesce(text, '')))) AS tokens, sum(length(lines_of(text, 1, 2))) AS heads FROM sql_documents GROUP BY 1")


@query(f"SELECT rel_path, start_line, end_line, name, n_chunks::BIGINT AS n_chunks FROM (SELECT 'o' || l_orderkey || '.go' AS rel_path, line AS start_line, line + q + 2 AS end_line, 'F' || n AS name, count(*) OVER (PARTITION BY l_orderkey) + 2 AS n_chunks FROM ({_UNIT}))")
def sql_chunks(spark, sf_dir):
    """Go files cut by table functions in a query that is SQL text alone: declarations, and the number of chunks of their file."""
    surface.register(spark)
    go_files(spark, sf_dir).createOrReplaceTempView("sql_go_files")
    return spark.sql("""
      SELECT d.rel_path, d.start_line, d.end_line, d.name, c.n_chunks
      FROM (SELECT rel_path, x.* FROM sql_go_files, LATERAL go_declarations(text) x) d
      JOIN (SELECT rel_path, count(*) AS n_chunks FROM sql_go_files, LATERAL code_chunks(text, 'go') GROUP BY rel_path) c ON d.rel_path = c.rel_path""")
