"""Queries composed over the stored index, and of repositories and evaluations, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserine.functions import names
from tesserine.operators import evaluation, postings, repos
from tesserine.plans.staging import scratch
from tesserine.queries.registry import QVEC, TERMS, bm25_sql, index_of, query, table

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9_]+'), lambda t: length(t) > 0)".format
_B = lambda terms, field="text", boost=1.0: f"SELECT doc_id, score * {boost} AS score FROM ({bm25_sql(terms, field, 15)})"


def _phrase(terms, field="text", boost=1.0):
    """The phrase as one term: its occurrences, the sum of the terms' weights."""
    held = " AND ".join(f"t[i + {k}] = '{w}'" for k, w in enumerate(terms))
    return f"""SELECT doc_id, {boost} * idf * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl)) AS score
      FROM (SELECT doc_id, len(t) AS dl, len(list_filter(range(1, len(t) + 1), lambda i: {held})) AS tf FROM (SELECT doc_id, {_TOKENS(field)} AS t FROM documents))
      CROSS JOIN (SELECT sum(ln(1 + (n - df + 0.5) / (df + 0.5))) AS idf, any_value(avgdl) AS avgdl FROM (SELECT unnest([{", ".join(f"'{w}'" for w in terms)}]) AS term)
        JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOKENS(field)}) AS term FROM documents) GROUP BY 1) USING (term) CROSS JOIN (SELECT count(*) AS n, avg(len({_TOKENS(field)})) AS avgdl FROM documents)) WHERE tf > 0"""


_all = " UNION ALL ".join
_max = lambda parts: f"SELECT doc_id, max(score) AS score FROM ({_all(parts)}) GROUP BY doc_id"
_sum = lambda parts: f"SELECT doc_id, sum(score) AS score FROM ({_all(parts)}) GROUP BY doc_id"
_ASKED = ("permission", "license", "src1")
_FIELDS = {"text": 3.0, "source": 4.0, "lang": 2.0}
_BEST = _max([_B(_ASKED, f, b) for f, b in _FIELDS.items()])
_ROUTED = "SELECT doc_id FROM documents WHERE source IN ('src0', 'src1', 'src2')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _routed(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.col("source").isin("src0", "src1", "src2")).select(F.col("doc_id").alias("key"))


def _named(hits):
    return hits.withColumnRenamed("key", "doc_id")


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_phrase(('licensed', 'under', 'the'))})")
def bm25_phrase_score(spark, sf_dir):
    return _named(postings.search(should=[index_of(spark, sf_dir).phrase("text", "Licensed under the")]))


@query(f"SELECT r.doc_id, round(coalesce(score, 0), 6) AS score FROM ({_ROUTED}) r LEFT JOIN ({_BEST}) USING (doc_id)")
def bm25_fielded(spark, sf_dir):
    """Best of the boosted fields under a repository filter; rows without a match stay at 0."""
    index = index_of(spark, sf_dir)
    return _named(postings.search(should=[index.best_fields(_FIELDS, list(_ASKED))], keys=_routed(spark, sf_dir)))


@query(f"SELECT doc_id, round(m.score + coalesce(b.score, 0), 6) AS score FROM ({_sum([_phrase(('licensed', 'under')), _phrase(('copyright',))])}) m LEFT JOIN ({_BEST}) b USING (doc_id) WHERE doc_id IN ({_ROUTED})")
def bm25_guarded(spark, sf_dir):
    """Rows that hold a topic term as a phrase, which scores as well."""
    return _named(postings.guarded(index_of(spark, sf_dir), " ".join(_ASKED), ["licensed under", "copyright"], _routed(spark, sf_dir), _FIELDS, ("text",)))


_GROUPS = (("license", "permission"), ("the", "of"))


@query(f"""SELECT doc_id, round(v.score + n.score + coalesce(b.score, 0) + 3.0 * (contains(source, 'c1'))::INT + 0.3 * (contains(source, 'src'))::INT + 0.3 * (contains(source, '2'))::INT, 6) AS score
  FROM ({_max([_B(_GROUPS[0], f) for f in ("text", "lang")])}) v JOIN ({_max([_B(_GROUPS[1], f) for f in ("text", "lang")])}) n USING (doc_id) LEFT JOIN ({_BEST}) b USING (doc_id) JOIN documents d USING (doc_id)""")
def bm25_by_intent(spark, sf_dir):
    """A word of each of two groups must match; path fragments add constants."""
    docs = _docs(spark, sf_dir)
    return _named(postings.by_intent(index_of(spark, sf_dir), " ".join(_ASKED), _GROUPS, docs, "doc_id", F.col("source"), _FIELDS, ("text", "lang"), ("c1",), ("src", "2")))


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_sum([_phrase(('permission', 'is', 'hereby'), boost=6.0), _max([_B(('permission', 'is', 'hereby'), f, b) for f, b in _FIELDS.items()])])}) WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en' AND contains(source, 'src'))")
def bm25_exact(spark, sf_dir):
    """The phrase at six times its score and the best field, of rows that pass filters; rows without a match are left out by a further condition."""
    keys = postings.filters(_docs(spark, sf_dir), "doc_id", project=F.col("lang") == "en", path=F.contains("source", F.lit("src")))
    return _named(postings.exact(index_of(spark, sf_dir), "permission is hereby", keys, fields=_FIELDS).where("score > 0"))


_KNN = "SELECT vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], [" + ", ".join(f"{x}::DOUBLE" for x in QVEC) + "]), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 50"


@query(f"SELECT doc_id, round(score, 6) AS score FROM ({_sum([_phrase(('permission', 'is', 'hereby'), boost=6.0), _max([_B(('permission', 'is', 'hereby'), f, b) for f, b in _FIELDS.items()]), f'SELECT * FROM ({_KNN})'])})")
def hybrid_exact(spark, sf_dir):
    """Phrase, best field and kNN scores in one sum."""
    from tesserine.operators import vectors

    knn = vectors.knn(table(spark, sf_dir, "embeddings"), QVEC, 50).select(F.col("vec_id").alias("key"), "score")
    return _named(postings.exact(index_of(spark, sf_dir), "permission is hereby", knn=knn, fields=_FIELDS))


_CLAUSES = (("source", "src1", 6.0), ("text", "license", 3.0), ("lang", "en", 2.0))


@query(f"""SELECT doc_id, round(coalesce(score, 0), 6) AS score FROM (SELECT doc_id FROM documents WHERE lang = 'en') LEFT JOIN ({_sum([_B((t,), f, b) for f, t, b in _CLAUSES] + [_B(TERMS, 'source', 2.0), _B(TERMS, 'text', 1.0)])}) USING (doc_id) ORDER BY 2 DESC, 1 LIMIT 300""")
def planned_candidates(spark, sf_dir):
    """Weighted clauses of a plan and the question's own words, of one language; the best 300."""
    docs = _docs(spark, sf_dir).withColumnRenamed("lang", "language")
    return _named(postings.planned(index_of(spark, sf_dir), docs, "doc_id", _CLAUSES, " ".join(TERMS), "en", ("source", "text")))


_ROUTER = {"short_title": ("p_name", 4.0), "summary": ("p_type", 3.0), "key_symbols": ("p_brand", 5.0)}
_PB = bm25_sql(("small", "economy", "brand", "2"), "{}", 15).replace("documents", "part").replace("doc_id", "p_partkey")


@query("SELECT p_partkey, round(max(score), 6) AS score FROM (" + _all([f"SELECT p_partkey, score * {b} AS score FROM ({_PB.replace('{}', c)})" for c, b in _ROUTER.values()]) + ") GROUP BY p_partkey")
def router_fielded(spark, sf_dir):
    """A router query over weighted fields, with parts for repositories."""
    path = scratch(spark, "router-index")
    postings.build(table(spark, sf_dir, "part"), "p_partkey", {name: F.col(column) for name, (column, _) in _ROUTER.items()}, path, 4)
    return postings.fielded(postings.Index(spark, path), "router_v2", "small economy brand#2").withColumnRenamed("key", "p_partkey")


# Repositories ------------------------------------------------------------------------------

_REL = "concat('dir', CAST(doc_id % 5 AS STRING), '/', coalesce(lang, 'xx'), '/sub', CAST(doc_id % 3 AS STRING), '/', CASE doc_id % 11 WHEN 0 THEN 'main.py' WHEN 1 THEN concat('test_', CAST(doc_id % 40 AS STRING), '.py') WHEN 2 THEN 'index.ts' ELSE concat('f', CAST(doc_id % 40 AS STRING), '.go') END)"
_CHUNKS = f"(SELECT coalesce(source, 'none') AS repo_id, CASE WHEN doc_id % 23 = 0 THEN 'top.txt' ELSE {_REL} END AS rel_path, doc_id AS chunk_number, (doc_id % 90)::INT AS start_line, (doc_id % 90 + 7)::INT AS end_line, text, lang AS language, coalesce(string_split(text, ' ')[1:3], []) AS symbols FROM documents)"


def _chunks(spark, sf_dir):
    return _docs(spark, sf_dir).selectExpr(
        "coalesce(source, 'none') AS repo_id", f"CASE WHEN doc_id % 23 = 0 THEN 'top.txt' ELSE {_REL} END AS rel_path", "doc_id AS chunk_number", "int(doc_id % 90) AS start_line", "int(doc_id % 90 + 7) AS end_line", "text", "lang AS language", "coalesce(slice(split(text, ' '), 1, 3), array()) AS symbols"
    )


_STATS = f"""(SELECT repo_id, rel_path, count(*) AS chunks, sum(length(coalesce(text, '')))::BIGINT AS size, sum(len(symbols))::BIGINT AS sym_count, arg_min(language, (start_line, chunk_number)) FILTER (language IS NOT NULL) AS language,
  round(sqrt(sum(length(coalesce(text, '')))) + sum(len(symbols)), 6) AS score FROM {_CHUNKS} GROUP BY 1, 2)"""
_TEST = "(" + " OR ".join(f"contains(lower(rel_path), '{t}')" for t in names.TESTS) + ")"
_top = lambda rows, value, k: f"(SELECT repo_id, string_agg({value}, '|' ORDER BY p) AS v FROM (SELECT repo_id, {value}, row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, {value}) AS p FROM {rows} WHERE {value} IS NOT NULL GROUP BY 1, 2) WHERE p <= {k} GROUP BY 1)"
_FILES = lambda k, where="true": f"(SELECT repo_id, rel_path, row_number() OVER (PARTITION BY repo_id ORDER BY score DESC, rel_path) AS p FROM {_STATS} WHERE {where} QUALIFY p <= {k})"
_MODULES = lambda rows: f"(SELECT repo_id, CASE WHEN contains(rel_path, '/') THEN split_part(rel_path, '/', 1) END AS m FROM {rows})"
_SYMS = f"(SELECT repo_id, unnest(symbols) AS s FROM {_CHUNKS})"


def _heads_sql(k, n_lines, where, chars=None):
    head = "string_agg(array_to_string(l[1:least(len(l), n - b)], chr(10)), chr(10) ORDER BY start_line, chunk_number)"
    head = f"CASE WHEN length({head}) > {chars} THEN left({head}, {chars}) || chr(10) || '# …(trimmed)…' ELSE {head} END" if chars else head
    return f"""(SELECT repo_id, p, rel_path || ':' || min(start_line) || '-' || max(end_line) || '=' || sha256({head}) AS h FROM (
      SELECT *, {n_lines} AS n, coalesce(sum(len(l)) OVER (PARTITION BY repo_id, rel_path ORDER BY start_line, chunk_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS b
      FROM (SELECT c.*, f.p, string_split(coalesce(text, ''), chr(10)) AS l FROM {_CHUNKS} c JOIN {_FILES(k, where)} f USING (repo_id, rel_path))) WHERE b < n GROUP BY repo_id, rel_path, p)"""


def _shown(packs, *columns):
    heads = F.array_join(F.transform("file_heads", lambda h: F.concat(h["rel_path"], F.lit(":"), F.get(h["span"], F.lit(0)).cast("string"), F.lit("-"), F.get(h["span"], F.lit(1)).cast("string"), F.lit("="), F.sha2(h["head"].cast("binary"), 256))), "|")
    return packs.select("repo_id", *[F.array_join(c, "|").alias(c) for c in columns], heads.alias("heads"))


@query(f"""SELECT r.repo_id, l.v AS languages, m.v AS modules, s.v AS top_symbols, f.v AS important_files, h.v AS heads FROM (SELECT DISTINCT repo_id FROM {_CHUNKS}) r
  LEFT JOIN {_top(_STATS, 'language', 5)} l USING (repo_id) LEFT JOIN {_top(_MODULES(_STATS), 'm', 10)} m USING (repo_id) LEFT JOIN {_top(_SYMS, 's', 60)} s USING (repo_id)
  LEFT JOIN (SELECT repo_id, string_agg(rel_path, '|' ORDER BY p) AS v FROM {_FILES(12, f'NOT {_TEST}')} GROUP BY 1) f USING (repo_id)
  LEFT JOIN (SELECT repo_id, string_agg(h, '|' ORDER BY p) AS v FROM {_heads_sql(4, 50, f'NOT {_TEST}')} GROUP BY 1) h USING (repo_id)""")
def router_packs(spark, sf_dir):
    """Router packs of every repository: languages, modules, symbols, important files and heads."""
    return _shown(repos.router_pack(_chunks(spark, sf_dir)), "languages", "modules", "top_symbols", "important_files")


_VOTED = f"(SELECT c.repo_id, c.rel_path, s.language AS lang FROM {_CHUNKS} c JOIN {_STATS} s USING (repo_id, rel_path))"
_ENTRY = "(" + " OR ".join(f"regexp_matches(rel_path, '(?i){p}')" for p in repos.ENTRYPOINTS) + ")"
_TREE = f"""(WITH d AS (SELECT DISTINCT repo_id, CASE WHEN contains(rel_path, '/') THEN array_to_string(string_split(rel_path, '/')[1:2], '/') ELSE '.' END AS k, CASE WHEN contains(rel_path, '/') THEN array_to_string(string_split(rel_path, '/')[1:3], '/') ELSE rel_path END AS c FROM {_STATS}),
  i AS (SELECT *, row_number() OVER (PARTITION BY repo_id, k ORDER BY c) AS i FROM d QUALIFY i <= 10), n AS (SELECT *, row_number() OVER (PARTITION BY repo_id ORDER BY k, i) AS n FROM i QUALIFY n <= 60)
  SELECT repo_id, string_agg(CASE WHEN i = 1 THEN k || '/' || chr(10) ELSE '' END || '  - ' || c, chr(10) ORDER BY n) || CASE WHEN max(n) >= 60 THEN chr(10) || '  ...' ELSE '' END AS v FROM n GROUP BY 1)"""


@query(f"""SELECT r.repo_id, l.v AS languages, m.v AS modules, s.v AS top_symbols, f.v AS top_files, t.v AS dir_tree, e.v AS entrypoints, h.v AS heads FROM (SELECT DISTINCT repo_id FROM {_CHUNKS}) r
  LEFT JOIN {_top(_VOTED, 'lang', 3)} l USING (repo_id) LEFT JOIN {_top(_MODULES(_VOTED), 'm', 8)} m USING (repo_id) LEFT JOIN {_top(_SYMS, 's', 30)} s USING (repo_id)
  LEFT JOIN (SELECT repo_id, string_agg(rel_path, '|' ORDER BY p) AS v FROM {_FILES(10)} GROUP BY 1) f USING (repo_id) LEFT JOIN {_TREE} t USING (repo_id)
  LEFT JOIN (SELECT repo_id, string_agg(rel_path, '|' ORDER BY rel_path) AS v FROM (SELECT repo_id, rel_path, row_number() OVER (PARTITION BY repo_id ORDER BY rel_path) AS p FROM {_STATS} WHERE {_ENTRY} QUALIFY p <= 5) GROUP BY 1) e USING (repo_id)
  LEFT JOIN (SELECT repo_id, string_agg(h, '|' ORDER BY p) AS v FROM {_heads_sql(6, 120, 'true', 8000)} GROUP BY 1) h USING (repo_id)""")
def guide_packs(spark, sf_dir):
    """Guide packs of every repository, with directory trees and entry points."""
    packs = repos.guide_pack(_chunks(spark, sf_dir))
    shown = _shown(packs, "languages", "modules", "top_symbols", "top_files", "entrypoints")
    return shown.join(packs.select("repo_id", "dir_tree"), "repo_id")


@query(f"SELECT repo_id, count(*) AS count FROM {_CHUNKS} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10000")
def repositories(spark, sf_dir):
    return repos.repositories(_chunks(spark, sf_dir))


@query(f"""WITH r AS (SELECT repo_id, rel_path, start_line, chunk_number, end_line, coalesce(text, '') AS t FROM {_CHUNKS}), w AS (SELECT *, coalesce(sum(length(t)) OVER p, 0) AS c, coalesce(sum(len(string_split(t, chr(10)))) OVER p, 0) AS l FROM r
    WINDOW p AS (PARTITION BY repo_id, rel_path ORDER BY start_line, chunk_number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT repo_id, rel_path, min(start_line) AS first, max(end_line) AS last, string_agg(t, chr(10) ORDER BY start_line, chunk_number) AS excerpt, sha1(string_agg(t, chr(10) ORDER BY start_line, chunk_number)) AS excerpt_sha1 FROM w WHERE c <= 20000 AND l <= 400 GROUP BY 1, 2""")
def file_guides(spark, sf_dir):
    """What each file's guide is written from."""
    return repos.file_guides(_chunks(spark, sf_dir))


_STRIP = "regexp_replace(coalesce(text, ''), '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')"


@query(f"SELECT rel_path AS file, count(*) AS n_chunks, coalesce(string_agg(t, chr(10) || chr(10) ORDER BY start_line, chunk_number) FILTER (t <> ''), '') AS text FROM (SELECT *, {_STRIP} AS t FROM {_CHUNKS}) GROUP BY 1")
def file_texts(spark, sf_dir):
    """The texts of each file's chunks put together."""
    return repos.file_texts(_chunks(spark, sf_dir))


# Evaluation --------------------------------------------------------------------------------

_RANKS = "(SELECT o_custkey AS query, o_orderkey % 50 AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY {}) AS rank FROM orders)".format
_A, _BR = _RANKS("o_totalprice DESC, o_orderkey"), _RANKS("o_orderdate, o_orderkey")
_REL_IDS = "(SELECT c_custkey AS query, (c_custkey + d) % 50 AS id FROM customer, range(0, 10) t(d) WHERE c_nationkey < 20)"


def _measured(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    ranked = lambda *order: orders.select(F.col("o_custkey").alias("query"), (F.col("o_orderkey") % 50).alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(*order)).alias("rank"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), "c_nationkey")
    relevant = customers.where("c_nationkey < 20").select("query", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("d")).select("query", ((F.col("query") + F.col("d")) % 50).alias("id"))
    return evaluation.compared(customers, ranked(F.desc("o_totalprice"), "o_orderkey"), ranked("o_orderdate", "o_orderkey"), relevant, 10)


_MEASURED = f"""(WITH a AS (SELECT query, list(id ORDER BY rank) AS a FROM {_A} WHERE rank <= 10 GROUP BY 1), b AS (SELECT query, list(id ORDER BY rank) AS b FROM {_BR} WHERE rank <= 10 GROUP BY 1), r AS (SELECT query, list(DISTINCT id) AS r FROM {_REL_IDS} GROUP BY 1),
  j AS (SELECT c_custkey AS query, coalesce(a, []) AS a, coalesce(b, []) AS b, coalesce(r, []) AS r FROM customer LEFT JOIN a ON c_custkey = a.query LEFT JOIN b ON c_custkey = b.query LEFT JOIN r ON c_custkey = r.query)
  SELECT query, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(list_concat(a, b))) END, 9) AS overlap,
    round(CASE WHEN len(a) > 0 AND len(r) > 0 THEN len(list_filter(a, lambda x: list_contains(r, x)))::DOUBLE / len(a) ELSE 0 END, 9) AS precision_a, round(CASE WHEN len(b) > 0 AND len(r) > 0 THEN len(list_filter(b, lambda x: list_contains(r, x)))::DOUBLE / len(b) ELSE 0 END, 9) AS precision_b FROM j)"""


@query(f"SELECT * FROM {_MEASURED}")
def ab_queries(spark, sf_dir):
    """Two rankings of every customer's orders: overlap and precision at 10."""
    return _measured(spark, sf_dir)


@query(f"SELECT count(*) AS n, round(avg(overlap), 6) AS overlap, round(avg(precision_a), 6) AS precision_a, round(avg(precision_b), 6) AS precision_b, round(avg(precision_b) - avg(precision_a), 6) AS gain FROM {_MEASURED}")
def ab_summary(spark, sf_dir):
    return evaluation.averages(_measured(spark, sf_dir))


@query(f"SELECT *, round(precision_b - precision_a, 9) AS measure FROM {_MEASURED} ORDER BY measure DESC, query LIMIT 5")
def ab_gains(spark, sf_dir):
    """The five queries that gain most precision."""
    return evaluation.best(_measured(spark, sf_dir), F.col("precision_b") - F.col("precision_a"))


@query("SELECT count(*) AS entries, count(DISTINCT user_id) AS files FROM events")
def cache_stats(spark, sf_dir):
    return evaluation.cache_stats(table(spark, sf_dir, "events"), "user_id")


@query("SELECT count_if(value > 20) AS hits, count_if(value <= 20) AS misses, printf('%.1f%%', 100.0 * count_if(value > 20) / count(*)) AS hit_rate FROM events")
def cache_hits(spark, sf_dir):
    return evaluation.hit_stats(table(spark, sf_dir, "events").select((F.col("value") > 20).alias("hit")))
