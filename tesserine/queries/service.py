"""Queries of the whole search, of enrichment, chunk structure and rules, with their SQL."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserine.functions import chunkers
from tesserine.operators import enrich, packs, rag, rules, service
from tesserine.queries.registry import QVEC, bm25_sql, index_of, query, table
from tesserine.queries.source_text import _SRC as SOURCES
from tesserine.queries.source_text import _source

# Search ------------------------------------------------------------------------------------

_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QVEC) + "]"
_CLAUSES = (("source", "src1", 6.0), ("text", "license", 3.0))
_WORDS = ("license", "the")
_REPOS = ("src0", "src1", "src2", "src3")
_CHUNK = "(SELECT doc_id AS id, source AS repo_id, 'f' || doc_id % 30 || '.go' AS rel_path, lang AS language, 'S' || doc_id % 9 AS primary_symbol, ['S' || doc_id % 9, 'T' || doc_id % 4] AS all_symbols, CASE doc_id % 4 WHEN 0 THEN ['complete'] WHEN 1 THEN ['declaration'] WHEN 2 THEN ['mixed'] ELSE [] END AS all_roles, text FROM documents)"
_KEPT = f"(SELECT * FROM {_CHUNK} WHERE repo_id IN ({', '.join(repr(r) for r in _REPOS)}) AND language = 'en')"
_PART = lambda terms, field, boost: f"SELECT doc_id AS id, score * {boost} AS score FROM ({bm25_sql(terms, field, 15)})"
_PARTS = " UNION ALL ".join([_PART((t,), f, b) for f, t, b in _CLAUSES] + [_PART(_WORDS, "source", 2.0), _PART(_WORDS, "text", 1.0)])


def _chunks(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr(
        "doc_id AS id", "source AS repo_id", "concat('f', CAST(doc_id % 30 AS STRING), '.go') AS rel_path", "lang AS language", "concat('S', CAST(doc_id % 9 AS STRING)) AS primary_symbol",
        "array(concat('S', CAST(doc_id % 9 AS STRING)), concat('T', CAST(doc_id % 4 AS STRING))) AS all_symbols", "CASE doc_id % 4 WHEN 0 THEN array('complete') WHEN 1 THEN array('declaration') WHEN 2 THEN array('mixed') ELSE array() END AS all_roles", "text",
    )


@query(f"""WITH k AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, 0 AS list FROM (SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE vec_id IN (SELECT id FROM {_KEPT}) ORDER BY score DESC, vec_id LIMIT 50)),
  b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank, 1 AS list FROM (SELECT c.id, round(coalesce(sum(p.score), 0), 6) AS score FROM {_KEPT} c LEFT JOIN ({_PARTS}) p ON c.id = p.id GROUP BY 1 ORDER BY score DESC, 1 LIMIT 300)),
  f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM k UNION ALL SELECT * FROM b) GROUP BY 1),
  h AS (SELECT c.*, f.score FROM {_CHUNK} c JOIN f USING (id)), r AS (SELECT primary_symbol AS s, max(CASE WHEN list_contains(all_roles, 'complete') THEN 2 WHEN list_contains(all_roles, 'declaration') THEN 1 ELSE 0 END) AS best FROM h GROUP BY 1),
  o AS (SELECT h.*, round(score + CASE WHEN primary_symbol IN ('S1', 'T2') THEN 0.25 ELSE 0 END + CASE WHEN list_has_any(all_symbols, ['S1', 'T2']) THEN 0.15 ELSE 0 END + CASE WHEN list_contains(all_roles, 'complete') THEN 0.10 WHEN list_contains(all_roles, 'declaration') THEN 0.05 ELSE 0 END
      + CASE WHEN contains(rel_path, 'f2') THEN 0.10 ELSE 0 END - CASE WHEN list_contains(all_roles, 'mixed') AND best >= 2 THEN 0.05 ELSE 0 END, 9) AS total FROM h JOIN r ON h.primary_symbol = r.s),
  d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY rel_path ORDER BY total DESC, id) <= 3), t AS (SELECT *, row_number() OVER (ORDER BY total DESC, id)::INT AS rank FROM d ORDER BY total DESC, id LIMIT 16)
  SELECT id, repo_id, rel_path, primary_symbol, total AS score, rank, CASE WHEN rank <= 8 THEN text END AS text FROM t""")
def hybrid_search(spark, sf_dir):
    """Fused search under repository and language filters, with symbol boosts, a cap a file and late texts."""
    embeddings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    found = rag.hybrid_search(_chunks(spark, sf_dir), embeddings, index_of(spark, sf_dir), QVEC, _CLAUSES, " ".join(_WORDS), _REPOS, "en", ("S1", "T2"), ("f2",), fields=("source", "text"))
    return found.select("id", "repo_id", "rel_path", "primary_symbol", "score", "rank", "text")


@query(f"""SELECT c.id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank::INT AS rank, text FROM (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM (SELECT vec_id AS id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents) ORDER BY score DESC, vec_id LIMIT 50)) k
  JOIN {_CHUNK} c USING (id) WHERE rank <= 5""")
def semantic_search(spark, sf_dir):
    """Vectors alone, texts of all hits; one file a document, no roles."""
    chunks = _chunks(spark, sf_dir).withColumn("rel_path", F.col("id").cast("string")).withColumn("all_roles", F.array().cast("array<string>"))
    embeddings = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding").join(chunks.select("id"), "id", "left_semi")
    found = rag.hybrid_search(chunks, embeddings, None, QVEC, (), "", semantic_only=True, k=5, with_text=None)
    return found.select("id", "score", "rank", "text")


@query("""SELECT c_custkey AS repo_id, CASE WHEN length(c_name || repeat(' x', 100)) > 200 THEN c_name || repeat(' x', 91) || '…' ELSE c_name || repeat(' x', 100) END AS short_title, '' AS summary, 3 AS n_languages, 15 AS n_modules, c_mktsegment AS keywords FROM customer""")
def router_contexts(spark, sf_dir):
    """Router documents as prompts show them, cut to their limits."""
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("repo_id"), F.concat("c_name", F.repeat(F.lit(" x"), F.lit(100))).alias("short_title"), F.lit(None).cast("string").alias("summary"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("languages"), F.lit(None).cast("array<string>").alias("tech_stack"),
        F.sequence(F.lit(1), F.lit(30)).cast("array<string>").alias("modules"), F.lit(None).cast("array<string>").alias("important_files"), F.lit("").alias("key_symbols"), F.col("c_mktsegment").alias("keywords"),
    )
    return service.router_contexts(rows).select("repo_id", "short_title", "summary", F.size("languages").alias("n_languages"), F.size("modules").alias("n_modules"), "keywords")


# Enrichment --------------------------------------------------------------------------------


def _stand_in():
    """A model that answers by the length of its prompt; every third length gets a reply that is no JSON."""
    return lambda prompts: ["?" if len(p) % 3 == 0 else json.dumps({"summary_en": f"Prompt of {len(p)} characters. More", "keywords_en": ["order book", "get it", "price list"]}) for p in prompts]


@query(f"""WITH c AS (SELECT doc_id AS id, coalesce(source, '') || CASE doc_id % 10 WHEN 0 THEN '/x.pb.go' ELSE '/x.go' END AS rel_path, coalesce(text, '') AS text, CASE WHEN doc_id % 6 = 0 THEN 'Kept.' END AS summary_en FROM documents),
  l AS (SELECT *, {len(enrich.ASK)} + {len('\nDeclaration: ')} + length('method Run') + {len('\nFile: ')} + length('A file.') + 5 + least(length(text), 6000) + 4 AS n,
    CASE WHEN summary_en IS NOT NULL THEN 'kept' WHEN ends_with(rel_path, '.pb.go') OR contains(lower(left(text, 1000)), 'code generated') OR contains(lower(left(text, 1000)), 'do not edit') THEN 'generated' WHEN text IN (SELECT text FROM c WHERE id % 7 = 0) THEN 'cached' ELSE 'model' END AS lane FROM c),
  m AS (SELECT *, CASE WHEN n % 3 > 0 THEN n ELSE n + {len(enrich.TIGHTEN) + 1} END AS asked FROM l)
  SELECT id, CASE WHEN lane = 'model' AND asked % 3 = 0 THEN 'fallback' ELSE lane END AS lane,
    CASE lane WHEN 'kept' THEN 'Kept.' WHEN 'generated' THEN CASE WHEN ends_with(rel_path, '.pb.go') THEN 'Gegenereerde protobuf-berichten en hulpfuncties; geen domeinlogica.' ELSE 'Gegenereerde code; geen domeinlogica.' END WHEN 'cached' THEN 'From the cache.'
      ELSE CASE WHEN asked % 3 = 0 THEN 'Method T.Run — order.' ELSE 'Prompt of ' || asked || ' characters' END END AS summary_en,
    CASE lane WHEN 'kept' THEN NULL WHEN 'generated' THEN CASE WHEN ends_with(rel_path, '.pb.go') THEN 'protobuf|gegenereerd|berichten|hulpmethoden|grpc' ELSE 'gegenereerd|code|automatisch|tool|geen-logica' END WHEN 'cached' THEN 'cached words' ELSE CASE WHEN asked % 3 = 0 THEN '' ELSE 'order book|price list' END END AS keywords_en FROM m""")
def enrichment(spark, sf_dir):
    """Summaries of every document by lane, with a stand-in for the model."""
    text = F.coalesce("text", F.lit(""))
    chunks = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.coalesce("source", F.lit("")), F.when(F.col("doc_id") % 10 == 0, "/x.pb.go").otherwise("/x.go")).alias("rel_path"), text.alias("text"), F.lit("method").alias("node_kind"), F.lit("Run").alias("primary_symbol"),
        F.lit("t *T").alias("receiver"), F.array(F.lit("Order"), F.lit("x")).alias("symbols"), F.lit("A file.").alias("synopsis"), F.when(F.col("doc_id") % 6 == 0, "Kept.").alias("summary_en"), F.lit(None).cast("array<string>").alias("keywords_en"),
    )
    cache = chunks.where("id % 7 = 0").select(F.concat_ws(":", F.lit("v1"), F.substring(F.sha2(F.col("text").cast("binary"), 256), 1, 16), F.substring(F.sha2(F.lit("A file.").cast("binary"), 256), 1, 8)).alias("cache_key"), F.struct(F.lit("From the cache.").alias("summary"), F.array(F.lit("cached words")).alias("keywords")).alias("value"))
    out = enrich.enriched(chunks, cache, _stand_in)
    return out.select("id", "lane", "summary_en", F.array_join("keywords_en", "|").alias("keywords_en"))


# Chunk structure ---------------------------------------------------------------------------

_CUTS = {"go": "[[1, 1], [2, 2], [3, 4], [5, 8], [9, 9]]", "py": "[[1, 1], [2, 3], [4, 4], [5, 8]]", "ts": "[[1, 2], [3, 3], [4, 4], [5, 5]]", "txt": "[[1, 1]]"}


@query(f"""WITH s AS ({SOURCES}), c AS (SELECT k, string_split(code, chr(10)) AS l, unnest(CASE ext {" ".join(f"WHEN '{e}' THEN {c}" for e, c in _CUTS.items())} END) AS c FROM s)
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY c[1])::INT AS chunk_number, c[1]::INT AS start_line, c[2]::INT AS end_line, array_to_string(l[c[1]:c[2]], chr(10)) AS text FROM c""")
def source_chunks(spark, sf_dir):
    """Source texts cut at their declarations, comments with what follows them."""
    return _source(spark, sf_dir).select("k", F.inline(chunkers.code_chunks(F.col("code"), F.col("ext"))))


@query(f"WITH s AS ({SOURCES}) SELECT k, array_to_string(string_split(code, chr(10))[2:4], chr(10)) AS text FROM s")
def line_ranges(spark, sf_dir):
    return _source(spark, sf_dir).select("k", chunkers.line_range(F.col("code"), F.lit(2), F.lit(4)).alias("text"))


@query(rf"""WITH s AS ({SOURCES}), m AS (SELECT k, o_custkey, regexp_extract(code, '(?m)^func\s*\(([^)]*)\)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(', 0) AS sig, regexp_extract(code, '(?m)^func\s*\(([^)]*)\)\s*([A-Za-z_][A-Za-z0-9_]*)\s*\(', 2) AS name FROM s),
  w AS (SELECT *, lag(sig, 2) OVER p AS s2, lag(sig, 1) OVER p AS s1, lag(name, 2) OVER p AS n2, lag(name, 1) OVER p AS n1 FROM m WINDOW p AS (PARTITION BY o_custkey ORDER BY k))
  SELECT k, CASE WHEN s2 <> '' THEN s2 WHEN s1 <> '' THEN s1 END AS signature, CASE WHEN s2 <> '' THEN n2 WHEN s1 <> '' THEN n1 END AS method FROM w""")
def enclosing_signatures(spark, sf_dir):
    """The method signature in the two chunks before each, with customers for files."""
    rows = _source(spark, sf_dir).withColumnRenamed("code", "text")
    return packs.enclosing_signature(rows, "o_custkey", ["k"]).select("k", "enclosing.signature", "enclosing.method")


_SPANS = "(SELECT o_custkey AS file, o_orderkey AS key, o_orderkey % 900 AS start, o_orderkey % 900 + o_orderkey % 7 AS finish FROM orders)"
_DECLS = "(SELECT o_custkey AS file, o_orderkey AS decl, o_orderkey % 700 AS d_start, o_orderkey % 700 + o_orderkey % 350 AS d_end FROM orders)"


@query(f"SELECT s.file, key, arg_min(decl, (d_end - d_start, d_start, decl)) AS owner FROM {_SPANS} s JOIN {_DECLS} d ON s.file = d.file AND d_start <= start AND finish <= d_end GROUP BY 1, 2")
def span_owners(spark, sf_dir):
    """The smallest declaration that contains each span."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("k"))
    spans = orders.selectExpr("file", "k AS key", "k % 900 AS start", "k % 900 + k % 7 AS end")
    return packs.owner(spans, orders.selectExpr("file", "k AS decl", "k % 700 AS d_start", "k % 700 + k % 350 AS d_end"), "file", "key")


_RULES = {
    "GO_AST_PATH_FORMAT": "m = 0 OR m = 1", "GO_HEADER_CONTEXT_PACKAGE": "m = 2", "GO_IMPORTS_MINIMAL_ALPHABETICAL": "m = 3", "GO_IMPORTS_BUILTIN_LEAK": "m = 4", "GO_SYMBOLS_DEFINED_PRESENT": "m = 5", "GO_SYMBOLS_SELF_REFERENCE": "m = 6",
    "GO_SYMBOLS_QUALIFIED_PREF": "m = 7", "GO_PATH_ID_NORMALIZED": "m = 8", "GO_NO_EMPTY_CHUNKS": "m = 9", "GO_QA_TERMS_COUNT_RANGE": "m = 10", "GO_HEADER_PRESENT_FIRST": "true", "GO_NEIGHBOR_CHAIN": "m = 11",
}


@query("SELECT code, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{code}' AS code FROM (SELECT o_orderkey % 12 AS m FROM orders) WHERE {where}" for code, where in _RULES.items()) + ") GROUP BY 1")
def chunk_rule_counts(spark, sf_dir):
    """Chunks that break each of the twelve rules, one chunk a file."""
    m, none, empty = F.col("m"), F.lit(None).cast("string"), F.array().cast("array<string>")
    pick = lambda n, value, other: F.when(m == n, value).otherwise(other)
    some = lambda *xs: F.array(*[F.lit(x) for x in xs])
    path = F.concat(F.lit("dir/"), F.col("o_orderkey").cast("string"))
    rows = table(spark, sf_dir, "orders").withColumn("m", F.col("o_orderkey") % 12).select(
        path.alias("path"), F.when(m == 8, F.lit("elsewhere")).otherwise(F.concat(path, F.lit("#1"))).alias("chunk_id"), F.lit(1).alias("start_line"),
        F.when(m == 0, "go:function:run").when(m == 1, "other").otherwise("go:function:Run").alias("ast_path"), pick(9, F.lit(" "), F.lit("x")).alias("text"), F.lit("x").alias("core"),
        F.when(m == 2, "import").when(m.isin(3, 4), "package p import (").otherwise("package p").alias("header_context"), pick(10, F.lit("a, b"), none).alias("qa_terms"),
        F.when(m == 3, some("b", "a")).when(m == 4, some("error", "x")).otherwise(empty).alias("imports_used"), pick(5, empty, some("Run")).alias("symbols_defined"),
        F.when(m == 6, some("Run")).when(m == 7, some("p.X", "X")).otherwise(empty).alias("symbols_referenced"), F.struct(pick(11, F.lit("before"), none).alias("prev"), none.alias("next")).alias("neighbors"),
    )
    return rules.violations(rows).groupBy("code").agg(F.count("*").alias("n"))
