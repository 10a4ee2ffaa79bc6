"""Queries of quality checks, gates, repairs, chosen chunks, chunk files and Go file context, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import chunkers
from tesserine.functions import text as T
from tesserine.operators import gates, models, packs, rag, rules, vectors
from tesserine.plans import report
from tesserine.plans.staging import scratch
from tesserine.queries.registry import ORACLES, index_of, query, table
from tesserine.queries.retrieval import _ASKED, _FIELDS, _routed
from tesserine.sources import chunks as files

_STRIPPED = r"regexp_replace({}, '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g')".format

# Chunks ------------------------------------------------------------------------------------

_N = "n_chars // 10"
_SUMMARY = "CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'short' WHEN 2 THEN '' ELSE 'a summary of this document' END"


@query(f"""WITH d AS (SELECT coalesce({_N}, 0) AS n, {_STRIPPED("coalesce(text, '')")} AS t, coalesce({_SUMMARY}, '') AS s, doc_id % 5 AS k FROM documents)
  SELECT * FROM (SELECT 'tiny' AS issue, count_if(n < 10) AS n FROM d UNION ALL SELECT 'huge', count_if(n > 1000) FROM d UNION ALL SELECT 'empty', count_if(t = '') FROM d
    UNION ALL SELECT 'incomplete', count_if(t <> '' AND right(t, 1) NOT IN ('}}', ')', ';', '"')) FROM d UNION ALL SELECT 'missing_summary', count_if(s = '') FROM d
    UNION ALL SELECT 'short_summary', count_if(s <> '' AND length(s) < 20) FROM d UNION ALL SELECT 'few_keywords', count_if(k IN (1, 2)) FROM d) WHERE n > 0""")
def issue_counts(spark, sf_dir):
    """The seven quality issues of all documents as chunks."""
    words = F.slice(F.array(*[F.lit(f"k{i}") for i in range(4)]), F.lit(1), (F.col("doc_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "documents").select(F.expr(_N.replace("//", "div")).alias("n_tokens"), "text", F.expr(_SUMMARY).alias("summary_en"), words.alias("keywords_en"))
    return packs.quality_issues(rows)


@query(f"""SELECT doc_id, lang FROM documents WHERE contains(coalesce(source, ''), 'src1') AND {_N} >= 50 AND {_N} <= 400 AND lang = 'en' AND {_STRIPPED(f"coalesce({_SUMMARY}, '')")} = ''""")
def chosen_chunks(spark, sf_dir):
    """Chunks by path, tokens, kind and absence of a summary."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("rel_path"), F.expr(_N.replace("//", "div")).alias("n_tokens"), F.col("lang").alias("node_kind"), F.expr(_SUMMARY).alias("summary_en"))
    return report.chosen(rows, "src1", 50, 400, "en", no_summary=True).select("doc_id", F.col("node_kind").alias("lang"))


@query("SELECT doc_id::VARCHAR AS id, coalesce(source, '') AS repo_id, coalesce(lang, '') AS rel_path, (doc_id % 50)::INT AS start_line, length(left(coalesce(text, ''), 30000)) AS n, left(sha256(coalesce(text, '')), 16) AS text_hash FROM documents WHERE doc_id % 9 <> 4")
def json_chunks(spark, sf_dir):
    """Chunks written as JSONL and read back, those whose line numbers aren't numbers skipped, with the hash of their text."""
    path = scratch(spark, "jsonl")
    line = F.when(F.col("doc_id") % 9 == 4, "none").otherwise((F.col("doc_id") % 50).cast("string"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("repo_id"), F.col("lang").alias("path"), line.alias("start_line"), F.lit("60").alias("end_line"), "text")
    files.write_lines(rows, path)
    found = files.index_rows(files.normalized(files.read_lines(spark, path), ()))
    return found.select("id", "repo_id", "rel_path", "start_line", F.length("embedding_text").alias("n"), "text_hash")


# Gates -------------------------------------------------------------------------------------

_LEXICON = {"licences": ("license", "permission"), "letters": ("the ", "que "), "none": ("zzzz",)}


@query("SELECT conv_id, turn, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(coalesce(text, '')), '{t}')" for t in terms) + f" THEN '{'|'.join(terms)}'" for terms in _LEXICON.values()) + " ELSE '' END AS terms FROM conversations")
def question_topics(spark, sf_dir):
    """The terms of the first topic that a turn touches."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(gates.topic_terms(F.col("text"), _LEXICON), "|").alias("terms"))


_ANSWER = "concat('# About ', coalesce(lang, ''), '\n\nFirst claim [r|a/', coalesce(source, 'x'), '.go:1-', doc_id, ']\n', CASE WHEN doc_id % 3 = 0 THEN 'no citation here\n' WHEN doc_id % 3 = 1 THEN 'cited early [r|b:2-3] then not\n' ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '```go\n```\n' ELSE '' END, repeat('More [r/c.go:7-9]  \n', CAST(doc_id % 6 AS INT)))"
_CITED = r"\[[^|\]]+[|/][^:\]]+:\d+-\d+\]"


@query(rf"""WITH a AS (SELECT doc_id, {_ANSWER} AS a FROM documents), l AS (SELECT *, list_filter(list_transform(string_split(a, chr(10)), lambda x: {_STRIPPED("x")}), lambda x: length(x) > 0 AND NOT starts_with(x, '```') AND NOT starts_with(x, '#')) AS l FROM a),
  s AS (SELECT *, len(list_filter(l, lambda x: regexp_matches(x, '{_CITED}\s*$')))::DOUBLE / len(l) AS share FROM l)
  SELECT doc_id, regexp_matches(a, '{_CITED}') AS cites, round(share, 6) AS share, share >= 0.8 AS valid FROM s""")
def citation_gates(spark, sf_dir):
    """Whether answers cite, the share of their lines that do, and whether that is enough."""
    answer = table(spark, sf_dir, "documents").select("doc_id", F.expr(_ANSWER).alias("a"))
    return answer.select("doc_id", gates.has_citation(F.col("a")).alias("cites"), F.round(gates.cited_share(F.col("a")), 6).alias("share"), gates.valid_answer(F.col("a")).alias("valid"))


_TERMS = "concat(coalesce(lang, ''), ', ', coalesce(source, ''), ';', upper(coalesce(lang, '')), ' ,, Extra', doc_id % 3, '; extra', doc_id % 2, ' ')"


@query(rf"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split_regex({_TERMS}, '[;,]'), lambda x: {_STRIPPED("x")}), lambda x: length(x) > 0) AS t FROM documents)
  SELECT doc_id, array_to_string(list_filter(t, lambda x, i: list_position(list_transform(t, lambda y: lower(y)), lower(x)) = i), '|') AS terms FROM t""")
def unique_terms(spark, sf_dir):
    """Listed terms, each once by lower case."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.clean_terms(F.expr(_TERMS)), "|").alias("terms"))


@query(ORACLES["bm25_guarded"])
def lexical_guarded(spark, sf_dir):
    """The lexical search of a version, which a topic makes a guarded one."""
    found = rag.lexical(index_of(spark, sf_dir), " ".join(_ASKED), _routed(spark, sf_dir), "v3", topic=["licensed under", "copyright"], fields=_FIELDS)
    return found.withColumnRenamed("key", "doc_id")


@query("SELECT conv_id, turn, 'system: Be brief.' || chr(10) || 'user: ' || coalesce(text, '') || chr(10) || 'user: role ' || coalesce(role, '') || chr(10) || 'user: Answer.' AS chat FROM conversations")
def chat_messages(spark, sf_dir):
    """The chat that an answering model is sent."""
    chat = models.messages("Be brief.", F.coalesce("text", F.lit("")), F.concat(F.lit("role "), F.coalesce("role", F.lit(""))), "Answer.")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.transform(chat, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n").alias("chat"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * (vec_id % 4)) AS v FROM embeddings)
  SELECT vec_id, round(CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE v[1] / sqrt(list_inner_product(v, v)) END, 6) AS first, CASE WHEN vec_id % 4 = 0 THEN 0.0 ELSE 1.0 END AS norm FROM v""")
def unit_vectors(spark, sf_dir):
    """Vectors scaled to length 1; a zero vector stays."""
    v = F.transform("embedding", lambda x: x.cast("double") * (F.col("vec_id") % 4))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalized(v).alias("v"))
    return rows.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(vectors.dot(F.col("v"), F.col("v")), 6).alias("norm"))


# Go ----------------------------------------------------------------------------------------

_IMPORTS = "concat('// Package p\npackage p', o_custkey % 9, '\n\nimport (\n\t\"b/c', o_orderkey % 4, '\"\n\tx \"a/y', o_custkey % 3, '\"\n)\n\nimport \"fmt\"\n\nvar s = \"q/z\"\n')"


@query(f"SELECT o_orderkey, 'p' || (o_custkey % 9) AS package, 'a/y' || (o_custkey % 3) || '|b/c' || (o_orderkey % 4) || '|fmt' AS imports, 'c' || (o_orderkey % 4) || '=b/c' || (o_orderkey % 4) || '|fmt=fmt|x=a/y' || (o_custkey % 3) AS aliases FROM orders")
def go_imports(spark, sf_dir):
    """Package, import paths and the names they go by."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_IMPORTS).alias("t"))
    names = F.array_sort(F.transform(F.map_entries(chunkers.go_aliases(F.col("t"))), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return rows.select("o_orderkey", chunkers.go_package(F.col("t")).alias("package"), F.array_join(chunkers.go_imports(F.col("t")), "|").alias("imports"), F.array_join(names, "|").alias("aliases"))


_REPAIR = "o_custkey % 60 AS f, o_orderkey AS k, o_orderkey % 20 = 0 AS head, o_orderkey % 13 = 0 AS blank"


@query(f"""WITH r AS (SELECT {_REPAIR}, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'package q' ELSE 'import "x"' END AS context FROM orders), k AS (SELECT * FROM r WHERE NOT blank),
  w AS (SELECT *, max(CASE WHEN head THEN 'p' || (f % 7) END) OVER (PARTITION BY f) AS package, lag(k) OVER o AS prev, lead(k) OVER o AS next FROM k WINDOW o AS (PARTITION BY f ORDER BY CASE WHEN head THEN 0 ELSE 1 END, k))
  SELECT 'd/' || f AS path, k, CASE WHEN head OR context = 'package q' THEN context WHEN context = '' THEN 'package ' || coalesce(package, 'main') ELSE 'package ' || coalesce(package, 'main') || chr(10) || chr(10) || context END AS header_context,
    CASE WHEN k % 4 = 0 THEN 'a|z' ELSE 'a|fmt' END AS imports, CASE WHEN k % 4 = 0 THEN 'p.X|Other' ELSE 'Y|q.Z' END AS symbols, prev, next FROM w""")
def repaired_chunks(spark, sf_dir):
    """Chunks with the repairable rules mended: order, package line, imports, symbols, neighbours."""
    some = lambda *xs: F.array(*[F.lit(x) for x in xs])
    four = F.col("k") % 4 == 0
    rows = table(spark, sf_dir, "orders").selectExpr(*_REPAIR.split(", ")).select(
        F.concat(F.when(F.col("k") % 2 == 0, "/d/").otherwise("d/"), F.col("f").cast("string")).alias("path"), F.col("k").cast("string").alias("chunk_id"), F.col("k").alias("start_line"), F.when(F.col("head"), "go:file_header").otherwise("go:function:F").alias("ast_path"),
        F.when(F.col("blank"), " ").when(F.col("head"), F.concat(F.lit("// x\npackage p"), (F.col("f") % 7).cast("string"), F.lit("\n"))).otherwise("x").alias("text"), F.when(F.col("blank"), "").otherwise("x").alias("core"),
        F.when(F.col("k") % 3 == 1, "package q").when(F.col("k") % 3 == 2, 'import "x"').otherwise("").alias("header_context"), F.when(four, some("z", "a", "error", "z")).otherwise(some("fmt", "a", "nil")).alias("imports_used"),
        some("F").alias("symbols_defined"), F.when(four, some("F", "X", "p.X", "Other")).otherwise(some("Y", "q.Z", "Z")).alias("symbols_referenced"), F.lit("").alias("qa_terms"), F.struct(F.lit(None).cast("string").alias("prev"), F.lit(None).cast("string").alias("next")).alias("neighbors"),
    )
    number = lambda c: F.col(c).cast("long")
    return rules.repaired(rows).select("path", number("chunk_id").alias("k"), "header_context", F.array_join("imports_used", "|").alias("imports"), F.array_join("symbols_referenced", "|").alias("symbols"), number("neighbors.prev").alias("prev"), number("neighbors.next").alias("next"))
