"""Queries of evidence, prompts, answers and the filter-rerank plan, with their SQL.

Documents stand in for sources: their source is the question they were retrieved for.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import answers, rag
from tesserine.queries.registry import query, table

_PATH = "concat(CASE doc_id % 4 WHEN 0 THEN 'src/tests/a' WHEN 1 THEN 'pkg/b' ELSE 'lib/c' END, CAST(doc_id % 6 AS STRING), CASE doc_id % 3 WHEN 0 THEN '.py' WHEN 1 THEN '_test.py' ELSE '' END)"
_SRC = f"(SELECT coalesce(source, 'none') AS query, doc_id, row_number() OVER (PARTITION BY coalesce(source, 'none') ORDER BY n_chars DESC, doc_id) AS rank, 'repo' || doc_id % 3 AS repo_id, {_PATH} AS rel_path, CASE WHEN doc_id % 5 > 0 THEN doc_id % 90 END AS start_line, CASE WHEN doc_id % 7 > 0 THEN doc_id % 90 + 9 END AS end_line, coalesce(text, '') AS code FROM documents)"
_TEST = "(contains(lower(rel_path), 'tests') OR contains(lower(rel_path), '/test') OR starts_with(lower(rel_path), 'test_') OR ends_with(lower(rel_path), '_test.py'))"
_PLACED = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_TEST}, rank) AS place FROM {_SRC})"


def _sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    name = F.coalesce("source", F.lit("none"))
    return docs.select(
        name.alias("query"), "doc_id", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.expr("concat('repo', CAST(doc_id % 3 AS STRING))").alias("repo_id"), F.expr(_PATH).alias("rel_path"),
        F.expr("CASE WHEN doc_id % 5 > 0 THEN doc_id % 90 END").alias("start_line"), F.expr("CASE WHEN doc_id % 7 > 0 THEN doc_id % 90 + 9 END").alias("end_line"), F.coalesce("text", F.lit("")).alias("code"),
    )


def _questions(spark, sf_dir):
    return _sources(spark, sf_dir).select("query").distinct().withColumn("question", F.concat(F.lit("  What of "), "query", F.lit("?\n")))


@query(f"SELECT query, doc_id, place FROM {_PLACED} WHERE place <= 12")
def implementation_first(spark, sf_dir):
    """Sources of each question, tests last."""
    return answers.implementation_first(_sources(spark, sf_dir), 12).select("query", "doc_id", "place")


_SPOT = f"(SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM (SELECT * FROM {_SRC} QUALIFY row_number() OVER (PARTITION BY query, rel_path ORDER BY rank) = 1) QUALIFY place <= 3)"


@query(f"SELECT query, doc_id, place FROM {_SPOT}")
def spotlights(spark, sf_dir):
    return answers.spotlights(_sources(spark, sf_dir), 3).select("query", "doc_id", "place")


_SPAN = "coalesce(start_line::VARCHAR, '?') || '-' || coalesce(end_line::VARCHAR, '?')"
_WHERE = f"repo_id || ' | ' || rel_path || ' | lines ' || {_SPAN}"
_EXT = "CASE WHEN contains(rel_path, '.') THEN lower(list_last(string_split(rel_path, '.'))) ELSE '' END"
_CLIP = lambda k: f"CASE WHEN len(string_split(code, chr(10))) > {k} THEN array_to_string(string_split(code, chr(10))[1:{k}], chr(10)) || chr(10) || '# …(trimmed)…' ELSE code END"
_FENCE = lambda k: f"'```' || {_EXT} || chr(10) || {_CLIP(k)} || chr(10) || '```'"


@query(f"SELECT query, chr(10) || '---' || chr(10) || '**Spotlight (auto)**' || chr(10) || string_agg(chr(10) || {_WHERE} || chr(10) || {_FENCE(15)} || chr(10) || '[' || repo_id || '|' || rel_path || ':' || {_SPAN} || ']', chr(10) ORDER BY place) AS spotlight FROM {_SPOT} GROUP BY 1")
def spotlight_section(spark, sf_dir):
    return answers.spotlight_section(_sources(spark, sf_dir))


_MOST = 9000


@query(f"""WITH b AS (SELECT query, place, '[#' || place || '] ' || {_WHERE} AS line, '===== Source #' || place || ': ' || {_WHERE} || chr(10) || {_FENCE(120)} AS block FROM {_PLACED} WHERE place <= 12),
  h AS (SELECT query, 'Question:' || chr(10) || 'What of ' || query || '?' || chr(10) || chr(10) || 'Cite.' || chr(10) || chr(10) || 'Sources:' || chr(10) || string_agg(line, chr(10) ORDER BY place) || chr(10) || chr(10) AS head, count(*) AS n, string_agg(block, chr(10) || chr(10) ORDER BY place) AS blocks FROM b GROUP BY 1),
  c AS (SELECT query, place, block, length(head) + sum(length(block) + 2) OVER (PARTITION BY query ORDER BY place) AS total, head FROM b JOIN h USING (query)),
  k AS (SELECT query, count(*) AS kept, string_agg(block, chr(10) || chr(10) ORDER BY place) AS blocks FROM c WHERE total <= {_MOST} GROUP BY 1),
  w AS (SELECT h.query, head || h.blocks || chr(10) || chr(10) || 'Topic check: unless a source has one of license, permission, reply: Not found in provided sources.' || chr(10) AS whole, head, n, coalesce(kept, 0) AS kept, coalesce(k.blocks, '') AS fitted FROM h LEFT JOIN k USING (query))
  SELECT query, CASE WHEN length(whole) > {_MOST} THEN head || fitted || CASE WHEN kept < n THEN chr(10) || chr(10) || '# NOTE: Some sources were omitted to fit prompt size.' ELSE '' END ELSE whole END AS prompt, (CASE WHEN length(whole) > {_MOST} THEN kept ELSE n END)::INT AS n_kept FROM w""")
def answer_prompts(spark, sf_dir):
    """Prompts of every question within 9,000 characters."""
    return answers.prompts(_questions(spark, sf_dir), _sources(spark, sf_dir), ["license", "permission"], most_chars=_MOST, instructions="Cite.")


@query("""SELECT c_custkey, '- ' || c_name || chr(10) || '  Languages: ' || CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'go, ' || lower(c_mktsegment) END || '  Entrypoints: ' || coalesce(c_mktsegment, '') || chr(10) || '  Modules: m' || c_nationkey || chr(10) || '  Overview: ' || chr(10) || '  Key Flows: ' || c_nationkey AS guide,
  '- ' || c_name || ' | ' || c_mktsegment || chr(10) || '  Languages: ' || CASE WHEN c_custkey % 3 = 0 THEN 'unknown' ELSE 'go, ' || lower(c_mktsegment) END || chr(10) || '  Modules: m' || c_nationkey || chr(10) || '  Symbols: ' || c_nationkey || chr(10) || '  Tech:   Entrypoints: ' || c_mktsegment || '  Domains: d' || chr(10) || '  Summary: s' AS router FROM customer""")
def repository_context(spark, sf_dir):
    """Guides and router documents as lines of a prompt, with customers for repositories."""
    rows = table(spark, sf_dir, "customer")
    languages = F.when(F.col("c_custkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("go"), F.lower("c_mktsegment")))
    none, key, name = F.lit(None).cast("string"), F.col("c_nationkey").cast("string"), F.col("c_name")
    modules, segment = F.concat(F.lit("m"), key), F.col("c_mktsegment")
    return rows.select("c_custkey", answers.guide_context(name, languages, segment, modules, none, key).alias("guide"), answers.router_context(name, segment, languages, modules, key, none, segment, F.lit("d"), F.lit("s")).alias("router"))


@query(f"""SELECT query, '1.2' AS version, 'q' AS question, len(list(doc_id)) AS n, sum(rank)::BIGINT AS ranks, sha256(string_agg({_CLIP(120)}, '|' ORDER BY rank)) AS code, 'repo0' AS first_repo FROM {_SRC} WHERE rank <= 10 GROUP BY query""")
def answer_bundles(spark, sf_dir):
    """Bundles of every question, read back from their JSON."""
    hits = _sources(spark, sf_dir).where("rank <= 10").withColumnsRenamed({"code": "text"}).withColumn("chunk_number", F.col("doc_id")).withColumn("score", F.lit(1.0))
    questions = hits.select("query").distinct().withColumn("question", F.lit("q"))
    context = questions.select("query", F.explode(F.array(F.lit("repo0"), F.lit("repo1"))).alias("repo_id"), F.lit("t").alias("short_title"))
    made = answers.bundle(questions, hits, context, context.where("repo_id = 'repo0'"))
    schema = "struct<version:string,query:string,routed_repo_ids:array<string>,sources:array<struct<idx:long,code:string>>>"
    read = made.select("query", F.from_json("bundle", schema).alias("b"))
    return read.select(
        "query", "b.version", F.col("b.query").alias("question"), F.size("b.sources").cast("long").alias("n"), F.aggregate("b.sources", F.lit(0).cast("long"), lambda s, x: s + x["idx"]).alias("ranks"),
        F.sha2(F.array_join(F.transform("b.sources", lambda x: x["code"]), "|").cast("binary"), 256).alias("code"), F.get("b.routed_repo_ids", F.lit(0)).alias("first_repo"),
    )


_UNIX = "replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_RSTRIP = lambda x: f"regexp_replace({x}, '[ \\t\\n\\x0B\\f\\r]+$', '')"


def _cut(text, most):
    head = f"left({text}, ({most})::INT)"
    last = lambda m: f"(length({head}) - strpos(reverse({head}), {m}))"
    at = f"CASE WHEN contains({head}, chr(10)) AND {last('chr(10)')} > 0.8 * ({most}) THEN {last('chr(10)')} WHEN contains({head}, ' ') AND {last(repr(' '))} > 0.8 * ({most}) THEN {last(repr(' '))} ELSE ({most}) END"
    return f"CASE WHEN length({text}) <= ({most}) THEN {text} ELSE {_RSTRIP(f'left({head}, ({at})::INT)')} END"


_CLOSED = lambda x: f"({x}) || CASE WHEN len(regexp_extract_all({x}, '```')) % 2 = 1 THEN chr(10) || '```' ELSE '' END"


@query(rf"""WITH d AS (SELECT doc_id, text, source, lang, {_UNIX} AS u FROM documents), c AS (SELECT *, {_cut('u', 1200)} AS c FROM d)
  SELECT doc_id, {_CLOSED('c')} AS filter_text, CASE WHEN len(string_split(u, chr(10))) > 40 THEN array_to_string(string_split(u, chr(10))[1:40], chr(10)) || chr(10) || '// ... (truncated)' ELSE u END AS relevant,
    left(regexp_replace(coalesce(nullif(text, ''), source, ''), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g'), 2000) AS rerank_text, lower(array_to_string([coalesce(left(text, 9000000), ''), 'A B', coalesce(source, ''), coalesce(lang, '')], ' ')) AS bag FROM c""")
def model_texts(spark, sf_dir):
    """Texts of every document as the filter, the reranker and the evidence gate read them."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", rag.filter_text(text).alias("filter_text"), rag.relevant_lines(rag.unix_lines(F.coalesce(text, F.lit("")))).alias("relevant"), rag.rerank_text(text, F.col("source")).alias("rerank_text"), rag.bag(text, F.array(F.lit("A"), F.lit("B")), F.col("source"), F.col("lang")).alias("bag")
    )


@query(rf"""WITH d AS (SELECT doc_id, coalesce(source, 'none') || ':' || doc_id || '-9' AS head, CASE WHEN doc_id % 3 > 0 THEN repeat('word ' || doc_id || ' ', (doc_id % 70)::INT) END AS summary, lang, {_UNIX} AS u, text FROM documents),
  s AS (SELECT *, 'Summary: ' || summary AS full_summary FROM d), t AS (SELECT *, CASE WHEN length(summary) > 0 THEN {_cut('full_summary', 200)} END AS short FROM s),
  n AS (SELECT *, length(head) + coalesce(length(short) + 1, 0) AS used, CASE WHEN len(string_split(u, chr(10))) > 30 THEN array_to_string(string_split(u, chr(10))[1:30], chr(10)) || chr(10) || '// ... (truncated)' ELSE u END AS body FROM t),
  c AS (SELECT *, {_cut('body', '750 - used')} AS cut FROM n)
  SELECT doc_id, head || coalesce(chr(10) || short, '') || CASE WHEN length(text) > 0 AND used < 700 THEN chr(10) || chr(10) || '```' || lower(coalesce(lang, '')) || chr(10) || {_CLOSED('cut')} || chr(10) || '```' ELSE '' END AS snippet FROM c""")
def rerank_snippets(spark, sf_dir):
    """Snippets of every document for a reranker, with made-up summaries."""
    summary = F.expr("CASE WHEN doc_id % 3 > 0 THEN repeat(concat('word ', CAST(doc_id AS STRING), ' '), int(doc_id % 70)) END")
    return table(spark, sf_dir, "documents").select("doc_id", T.rerank_snippet(F.coalesce("source", F.lit("none")), F.col("doc_id"), F.lit(9), summary, F.col("lang"), F.col("text")).alias("snippet"))


_RATED = "(SELECT coalesce(d.source, 'none') AS query, d.doc_id AS id, row_number() OVER (PARTITION BY coalesce(d.source, 'none') ORDER BY n_chars DESC, d.doc_id) AS rank, round(1.0 / (1 + n_chars), 9) AS retriever_score, (CASE WHEN coalesce(d.source, 'none') < 'src15' THEN quality * 3 + (1 - toxic) ELSE d.doc_id % 9 // 8 END)::INT AS filter_score FROM documents d JOIN labels USING (doc_id))"
_KEPT = f"""(WITH w AS (SELECT *, coalesce(stddev_samp(filter_score) OVER p, 0) AS spread, sum((filter_score >= 3)::INT) OVER p AS c3, sum((filter_score >= 2)::INT) OVER p AS c2, sum((filter_score >= 1)::INT) OVER p AS c1, row_number() OVER (PARTITION BY query ORDER BY retriever_score DESC, id) AS r FROM {_RATED} WINDOW p AS (PARTITION BY query)),
  a AS (SELECT *, CASE WHEN c3 >= 8 THEN 3 WHEN c2 >= 8 THEN 2 WHEN c1 >= 8 THEN 1 END AS lvl FROM w),
  k AS (SELECT *, CASE WHEN spread < 0.15 THEN 'guard' WHEN lvl IS NULL THEN 'retriever' ELSE 'at_' || lvl END AS lane, round(CASE WHEN spread < 0.15 THEN retriever_score ELSE retriever_score + 0.3 * filter_score / 4 END, 6) AS hybrid FROM a WHERE spread < 0.15 OR filter_score >= lvl OR (lvl IS NULL AND r <= 16)),
  n AS (SELECT *, count(*) OVER (PARTITION BY query) AS n FROM k)
  SELECT query, id, lane, hybrid, filter_score, row_number() OVER (PARTITION BY query ORDER BY hybrid DESC, id)::INT AS rank FROM n WHERE n >= 8
  UNION ALL SELECT query, id, 'baseline', 0.0, 1, rank::INT FROM {_RATED} WHERE rank <= 8 AND query NOT IN (SELECT query FROM n WHERE n >= 8))"""


def _rated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    name = F.coalesce("source", F.lit("none"))
    rows = docs.select(name.alias("query"), F.col("doc_id").alias("id"), F.row_number().over(Window.partitionBy(name).orderBy(F.desc("n_chars"), "doc_id")).alias("rank"), F.round(F.lit(1.0) / (F.col("n_chars") + 1), 9).alias("retriever_score"), "quality", "toxic")
    return rows.withColumn("filter_score", F.expr("int(CASE WHEN query < 'src15' THEN quality * 3 + (1 - toxic) ELSE floor(id % 9 / 8) END)")).drop("quality", "toxic")


@query(f"SELECT * FROM {_KEPT}")
def filter_survivors(spark, sf_dir):
    """Rows that pass the filter, or the first eight recalled ones."""
    return rag.survivors(_rated(spark, sf_dir))


@query(f"""WITH e AS (SELECT k.query, k.id, k.filter_score, coalesce(CASE WHEN k.id % 4 > 0 THEN n_chars % 11 - 5.0 END, 0.0) AS rerank_score, k.id || ':' || left(sha256(coalesce(text, '')), 8) AS prov FROM {_KEPT} k JOIN documents d ON k.id = d.doc_id)
  SELECT query, id, rerank_score::DOUBLE AS rerank_score, row_number() OVER (PARTITION BY query ORDER BY rerank_score DESC, filter_score DESC, prov)::INT AS item FROM e QUALIFY item <= 8""")
def evidence_choice(spark, sf_dir):
    """The eight chunks of each question's evidence by rerank score; chunks that weren't scored count as 0."""
    docs = table(spark, sf_dir, "documents")
    filtered = rag.survivors(_rated(spark, sf_dir))
    chunks = docs.select(F.coalesce("source", F.lit("none")).alias("query"), F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("chunk_hash"))
    scores = docs.where("doc_id % 4 > 0").select(F.coalesce("source", F.lit("none")).alias("query"), F.col("doc_id").alias("id"), (F.col("n_chars") % 11 - 5.0).cast("double").alias("rerank_score"))
    return rag.evidence_rows(filtered, scores, chunks).select("query", "id", "rerank_score", "item")
