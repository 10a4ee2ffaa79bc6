"""All queries of the engine over the test tables, with their SQL.

The documents table stands in for chunks (source: repository, doc_id: chunk), pages for source
files, labels for filter decisions and events for cache entries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import bm25, filtering, fusion, packs, postings, vectors
from tesserine.plans.staging import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TERMS = ("license", "the", "que")
#: The query vector of the kNN queries: a fixed direction.
QVEC = tuple(1.0 if i % 2 else -1.0 for i in range(64))
_Q = "[" + ", ".join(f"{x}::DOUBLE" for x in QVEC) + "]"
_TOK = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9_]+'), lambda t: length(t) > 0)"
_WS = r"[ \t\n\x0B\f\r]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# BM25 --------------------------------------------------------------------------------------

_INDEXES: dict[tuple[str, ...], postings.Index] = {}


def _stamp(df: DataFrame) -> str:
    """A value that changes with the files of a table: their paths, sizes and times."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").groupBy("file_path", "file_size", "file_modification_time").count()
    return str(files.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("*"), F.lit(1 << 31)))).first())


def build_index(spark: SparkSession, sf_dir: str) -> str:
    """Write the index of the documents (text, source, lang); its path."""
    path = scratch(spark, "index")
    postings.build(table(spark, sf_dir, "documents"), "doc_id", {"text": F.col("text"), "source": F.col("source"), "lang": F.col("lang")}, path, 8)
    return path


def index_of(spark: SparkSession, sf_dir: str) -> postings.Index:
    """The stored index of the documents, built once an application and state of the table."""
    key = (spark.sparkContext.applicationId, sf_dir, _stamp(table(spark, sf_dir, "documents")))
    if key not in _INDEXES:
        _INDEXES[key] = postings.Index(spark, build_index(spark, sf_dir))
    return _INDEXES[key]


_FIELD_TOKENS = " UNION ALL ".join(f"SELECT '{f}' AS field, doc_id, {_TOK.format(f'coalesce({f}, chr(0))')} AS t FROM documents" for f in ("text", "source", "lang"))


@query(f"""SELECT field, n, round(avgdl, 6) AS avgdl, coalesce(terms, 0) AS terms, coalesce(rows, 0) AS rows, coalesce(tokens, 0)::BIGINT AS tokens, coalesce(places, 0)::BIGINT AS places
  FROM (SELECT field, count(*) AS n, avg(len(t)) AS avgdl FROM ({_FIELD_TOKENS}) GROUP BY field)
  LEFT JOIN (SELECT field, count(DISTINCT term) AS terms, count(*) AS rows, sum(tf) AS tokens, sum(places) AS places
    FROM (SELECT field, doc_id, term, count(*) AS tf, sum(i) AS places FROM (SELECT field, doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM ({_FIELD_TOKENS})) GROUP BY 1, 2, 3) GROUP BY field) USING (field)""")
def postings_build(spark, sf_dir):
    """Builds the index and counts what it holds."""
    path = build_index(spark, sf_dir)
    places = F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)).alias("places")
    terms = spark.read.parquet(f"{path}/terms").groupBy("field").agg(F.count("*").alias("terms"))  # one row a term
    held = spark.read.parquet(f"{path}/postings").groupBy("field").agg(F.count("*").alias("rows"), F.sum("tf").alias("tokens"), places).join(terms, "field")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return spark.read.parquet(f"{path}/fields").join(held, "field", "left").select("field", "n", F.round("avgdl", 6).alias("avgdl"), *[zero(c) for c in ("terms", "rows", "tokens", "places")])


def _matched(spark: SparkSession, sf_dir: str, terms, field: str = "text") -> DataFrame:
    return postings.search(should=[index_of(spark, sf_dir).match(field, list(terms))]).withColumnRenamed("key", "doc_id")


def bm25_sql(terms, text: str = "text", digits: int = 6) -> str:
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""
      SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), {digits}) AS score
      FROM (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, unnest(toks) AS term, len(toks) AS dl FROM (SELECT doc_id, {_TOK.format(text)} AS toks FROM documents)) WHERE term IN ({names}) GROUP BY 1, 2) p
      JOIN (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({_TOK.format(text)}) AS term FROM documents) GROUP BY 1) d USING (term)
      CROSS JOIN (SELECT count(*) AS n, avg(len({_TOK.format(text)})) AS avgdl FROM documents) s GROUP BY doc_id"""


@query(bm25_sql(("license",)))
def bm25_single_term(spark, sf_dir):
    return _matched(spark, sf_dir, ["license"])


@query(bm25_sql(TERMS))
def bm25_match(spark, sf_dir):
    return _matched(spark, sf_dir, TERMS)


@query(f"SELECT doc_id, coalesce(score, 0) AS score FROM documents LEFT JOIN ({bm25_sql(('license',))}) USING (doc_id) WHERE source IN ('src0', 'src1')")
def bm25_filtered_zero_rows(spark, sf_dir):
    """A filter with should clauses keeps rows that match nothing, at score 0; statistics stay index-wide."""
    docs = table(spark, sf_dir, "documents")
    hits = _matched(spark, sf_dir, ["license"])
    return docs.where(F.col("source").isin("src0", "src1")).select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))


@query(f"SELECT doc_id, round(max(score), 6) AS score FROM (SELECT doc_id, score * 3.0 AS score FROM ({bm25_sql(('src1', 'license'), digits=15)}) UNION ALL SELECT doc_id, score * 4.0 FROM ({bm25_sql(('src1', 'license'), 'source', 15)})) GROUP BY doc_id")
def bm25_best_fields(spark, sf_dir):
    found = index_of(spark, sf_dir).best_fields({"text": 3.0, "source": 4.0}, ["src1", "license"])
    return found.select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query(f"SELECT doc_id FROM documents WHERE contains(' ' || array_to_string({_TOK.format('text')}, ' ') || ' ', ' licensed under the ')")
def bm25_phrase(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(bm25.has_phrase(F.col("text"), ["licensed", "under", "the"])).select("doc_id")


@query(f"""SELECT doc_id, source, score FROM (SELECT doc_id, source, score, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY score DESC, doc_id) AS p
           FROM ({bm25_sql(TERMS)}) JOIN documents USING (doc_id)) WHERE p <= 3 ORDER BY score DESC, doc_id LIMIT 16""")
def bm25_diversified(spark, sf_dir):
    """BM25, at most three hits a source, best 16."""
    docs = table(spark, sf_dir, "documents")
    hits = _matched(spark, sf_dir, TERMS).join(docs.select("doc_id", "source"), "doc_id")
    return fusion.top(fusion.diversify(hits, "source", "doc_id"), 16, "doc_id").select("doc_id", "source", "score")


@query(f"SELECT source, round(sum(score), 4) AS score FROM ({bm25_sql(TERMS)}) JOIN documents USING (doc_id) GROUP BY source ORDER BY 2 DESC, 1 LIMIT 2")
def router_score(spark, sf_dir):
    """The two repositories whose chunks score best in sum."""
    docs = table(spark, sf_dir, "documents")
    hits = _matched(spark, sf_dir, TERMS).join(docs.select("doc_id", "source"), "doc_id")
    return hits.groupBy("source").agg(F.round(F.sum("score"), 4).alias("score")).orderBy(F.desc("score"), "source").limit(2)


# Vectors and fusion ------------------------------------------------------------------------

_KNN = f"SELECT vec_id, score, row_number() OVER (ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], {_Q}), 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT {{}})"
_RANKED = f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM (SELECT * FROM ({bm25_sql(TERMS)}) ORDER BY score DESC, doc_id LIMIT 300)"


@query(_KNN.format(50))
def knn_topk(spark, sf_dir):
    return vectors.knn(table(spark, sf_dir, "embeddings"), QVEC, 50)


@query(_KNN.format(25).replace("FROM embeddings", "FROM embeddings WHERE label IN (1, 3)"))
def knn_filtered(spark, sf_dir):
    return vectors.knn(table(spark, sf_dir, "embeddings").where(F.col("label").isin(1, 3)), QVEC, 25)


@query(f"""SELECT doc_id, round(coalesce(k.score, 0) + coalesce(b.score, 0), 6) AS score FROM (SELECT vec_id AS doc_id, score FROM ({_KNN.format(50)})) k FULL JOIN ({_RANKED}) b USING (doc_id)""")
def hybrid_sum(spark, sf_dir):
    """kNN and BM25 scores summed in one list."""
    k, b = _lists(spark, sf_dir)
    return k.select("doc_id", F.col("score").alias("k")).join(b.select("doc_id", F.col("score").alias("b")), "doc_id", "full").select("doc_id", F.round(F.coalesce("k", F.lit(0.0)) + F.coalesce("b", F.lit(0.0)), 6).alias("score"))


def _lists(spark, sf_dir):
    k = vectors.knn(table(spark, sf_dir, "embeddings"), QVEC, 50).withColumnRenamed("vec_id", "doc_id")
    b = vectors.ranked(fusion.top(_matched(spark, sf_dir, TERMS), 300, "doc_id"), "doc_id")
    return k, b


_RRF = f"""SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list) AS first_list, min_by(rank, list) AS first_rank
           FROM (SELECT vec_id AS doc_id, 0 AS list, rank FROM ({_KNN.format(50)}) UNION ALL SELECT doc_id, 1, rank FROM ({_RANKED})) GROUP BY doc_id"""


@query(_RRF)
def rrf_two_lists(spark, sf_dir):
    return fusion.rrf(list(_lists(spark, sf_dir)), "doc_id")


@query(f"""SELECT doc_id, source, round(score + CASE WHEN d.lang = 'en' THEN 0.25 WHEN d.lang = 'fr' THEN 0.10 ELSE 0 END - CASE WHEN n_chars < 200 THEN 0.05 ELSE 0 END, 9) AS score
           FROM ({_RRF}) JOIN documents d USING (doc_id)""")
def boosted_fusion(spark, sf_dir):
    """Additive role boosts after fusion."""
    fused = fusion.rrf(list(_lists(spark, sf_dir)), "doc_id").select("doc_id", "score").join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars"), "doc_id")
    boost = F.when(F.col("lang") == "en", 0.25).when(F.col("lang") == "fr", 0.10).otherwise(0.0) - F.when(F.col("n_chars") < 200, 0.05).otherwise(0.0)
    return fused.select("doc_id", "source", F.round(F.col("score") + boost, 9).alias("score"))


@query(f"""WITH f AS (SELECT doc_id, source, score FROM ({_RRF}) JOIN documents USING (doc_id)),
           t AS (SELECT doc_id, source, score FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY score DESC, doc_id) AS p FROM f) WHERE p <= 3 ORDER BY score DESC, doc_id LIMIT 16),
           r AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id)::INT AS rank FROM t)
           SELECT r.*, CASE WHEN rank <= 8 THEN text END AS text FROM r JOIN documents USING (doc_id)""".replace("SELECT r.*, CASE", "SELECT r.doc_id, r.source, r.score, r.rank, CASE"))
def search(spark, sf_dir):
    """Fused search: per-repository cap, best 16, text fetched late and for the first eight only."""
    docs = table(spark, sf_dir, "documents")
    fused = fusion.rrf(list(_lists(spark, sf_dir)), "doc_id").select("doc_id", "score").join(docs.select("doc_id", "source"), "doc_id")
    best = vectors.ranked(fusion.top(fusion.diversify(fused, "source", "doc_id"), 16, "doc_id"), "doc_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(best.where("rank <= 8").select("doc_id")), "doc_id")  # eight rows
    return best.join(texts, "doc_id", "left").select("doc_id", "source", "score", "rank", "text")


@query("SELECT d.doc_id, d.source FROM documents d WHERE d.source IN (SELECT source FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 2)")
def route_semi_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    routed = docs.groupBy("source").count().orderBy(F.desc("count"), "source").limit(2)
    return docs.join(F.broadcast(routed.select("source")), "source", "left_semi").select("doc_id", "source")  # two rows


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def guides_missing_anti_join(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").distinct().join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


# Filtering ---------------------------------------------------------------------------------

_ROWS = "SELECT d.source, d.doc_id, round(1.0 / (1 + n_chars), 9) AS retriever_score, (quality * 3 + (1 - toxic))::INT AS filter_score FROM documents d JOIN labels USING (doc_id)"


@query(f"""WITH w AS (SELECT *, coalesce(stddev_samp(filter_score) OVER p, 0) AS spread, sum((filter_score >= 3)::INT) OVER p AS c3, sum((filter_score >= 2)::INT) OVER p AS c2, sum((filter_score >= 1)::INT) OVER p AS c1,
             row_number() OVER (PARTITION BY source ORDER BY retriever_score DESC, doc_id) AS r FROM ({_ROWS}) WINDOW p AS (PARTITION BY source)),
           a AS (SELECT *, CASE WHEN c3 >= 8 THEN 3 WHEN c2 >= 8 THEN 2 WHEN c1 >= 8 THEN 1 END AS lvl FROM w),
           k AS (SELECT *, CASE WHEN spread < 0.15 THEN 'guard' WHEN lvl IS NULL THEN 'retriever' ELSE 'at_' || lvl END AS lane, round(CASE WHEN spread < 0.15 THEN retriever_score ELSE retriever_score + 0.3 * filter_score / 4 END, 6) AS hybrid
                 FROM a WHERE spread < 0.15 OR filter_score >= lvl OR (lvl IS NULL AND r <= 16))
           SELECT source, doc_id, lane, hybrid, row_number() OVER (PARTITION BY source ORDER BY hybrid DESC, doc_id)::INT AS rank FROM k""")
def guarded_filter(spark, sf_dir):
    """Variance guard, relaxed thresholds and hybrid order for each repository."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    rows = rows.select("source", "doc_id", F.round(1.0 / (1 + F.col("n_chars")), 9).alias("retriever_score"), (F.col("quality") * 3 + 1 - F.col("toxic")).cast("int").alias("filter_score"))
    return filtering.guarded(rows, "source", "doc_id")


@query("SELECT doc_id, source, round(1 - (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / count(*) OVER (PARTITION BY source)::DOUBLE, 9) AS score FROM documents")
def fallback_scores(spark, sf_dir):
    return filtering.fallback_scores(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", ["doc_id"])


def _text_query(name: str, sql: str, build: Callable[[], object], alias: str = "value", source: str = "documents", key: str = "doc_id") -> None:
    """A query of one expression over every row of a table."""

    def run(spark, sf_dir):
        return table(spark, sf_dir, source).select(key, build().alias(alias))

    run.__name__ = name
    query(f"SELECT {key}, {sql} AS {alias} FROM {source}")(run)


_none = lambda kind="string": F.lit(None).cast(kind)
_S = f"regexp_replace({{}}, '^{_WS}+|{_WS}+$', '', 'g')"
_R = f"regexp_replace({{}}, '{_WS}+$', '')"
_L = "string_split(text, chr(10))"
_FIRST = _L.replace("text", "{}")
for _name, _sql, _build in (
    ("truncate_ellipsis", f"CASE WHEN length({_S.format('text')}) > 200 THEN {_R.format('substr(' + _S.format('text') + ', 1, 200)')} || '…' ELSE {_S.format('text')} END", lambda: T.truncate(F.col("text"), 200)),
    ("clip_lines", f"CASE WHEN len({_L}) > 3 THEN array_to_string(list_slice({_L}, 1, 3), chr(10)) || chr(10) || '... (trimmed)' ELSE text END", lambda: T.clip_lines(F.col("text"), 3)),
    (
        "safe_truncate",
        f"""CASE WHEN length(text) <= 300 THEN text ELSE {_R.format("substr(substr(text, 1, 300), 1, CASE WHEN strpos(substr(text, 1, 300), chr(10)) > 0 AND 300 - strpos(reverse(substr(text, 1, 300)), chr(10)) > 240 THEN 300 - strpos(reverse(substr(text, 1, 300)), chr(10)) WHEN strpos(substr(text, 1, 300), ' ') > 0 AND 300 - strpos(reverse(substr(text, 1, 300)), ' ') > 240 THEN 300 - strpos(reverse(substr(text, 1, 300)), ' ') ELSE 300 END)")} END""",
        lambda: T.safe_truncate(F.col("text"), 300),
    ),
    ("close_fences", "CASE WHEN len(regexp_extract_all(text, '```')) % 2 = 1 THEN text || chr(10) || '```' ELSE text END", lambda: T.close_fences(F.col("text"))),
    ("trim_code", "CASE WHEN length(text) > 1200 THEN substr(text, 1, 840) || chr(10) || '...' || chr(10) || right(text, 300) ELSE text END", lambda: T.trim_code(F.col("text"))),
    ("first_declaration_line", f"coalesce(list_filter(list_transform({_L}, lambda x: {_S.format('x')}), lambda x: length(x) > 0)[1], '')", lambda: T.first_line(F.col("text"))),
    (
        "embedding_text",
        f"""'[repo]: ' || coalesce(source, '') || chr(10) || '[path]: ' || doc_id || chr(10) || '[lang]: ' || coalesce(lang, '') || chr(10) || '[symbol]:  ()'
            || coalesce(chr(10) || chr(10) || '[signature]:' || chr(10) || list_filter(list_transform({_L}, lambda x: {_S.format("x")}), lambda x: length(x) > 0)[1], '') || chr(10) || chr(10) || '[code]:' || chr(10)
            || CASE WHEN text IS NULL THEN '' WHEN length(text) > 1200 THEN substr(text, 1, 840) || chr(10) || '...' || chr(10) || right(text, 300) ELSE text END""",
        lambda: T.embedding_text(F.col("source"), F.col("doc_id"), F.col("lang"), _none(), _none(), _none("array<string>"), _none(), _none("array<string>"), _none(), F.col("text")),
    ),
    ("provenance_id", "doc_id || ':' || substr(sha256(coalesce(text, '')), 1, 8)", lambda: T.provenance_id(F.col("doc_id"), F.lit(None).cast("string"), F.col("text"))),
    ("cache_key", "concat_ws(':', 'v2', substr(sha256('how'), 1, 16), doc_id::VARCHAR, substr(sha256(coalesce(text, '')), 1, 16))", lambda: T.cache_key("v2", F.lit("how"), F.col("doc_id"), F.col("text"))),
    ("secrets_filter", "(" + " OR ".join(f"regexp_matches(text, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in T.SECRET_PATTERNS) + ")", lambda: T.has_secret(F.col("text"))),
    ("looks_english", "round(CASE WHEN length(text) = 0 THEN 1 ELSE length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) END, 9)", lambda: F.round(T.ascii_ratio(F.col("text")), 9)),
    ("citations_extract", "list_sort(list_distinct(list_transform(regexp_extract_all(text, '\\[(\\d+)\\]', 1), lambda x: x::INT)))::VARCHAR", lambda: F.concat(F.lit("["), F.array_join(F.transform(T.citations(F.col("text")), lambda x: x.cast("string")), ", "), F.lit("]"))),
    ("content_hash", "sha256(coalesce(text, ''))", lambda: F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)),
    ("meaningful_tokens", "len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+'), lambda t: length(t) >= 3 AND t NOT IN (" + ", ".join(f"'{s}'" for s in T.STOPWORDS) + "))))", lambda: F.size(T.meaningful(F.col("text")))),
    ("topic_gate", "(contains(lower(text), 'license') OR contains(lower(text), 'password'))", lambda: F.exists(F.array(F.lit("license"), F.lit("password")), lambda t: F.contains(F.lower("text"), t))),
    (
        "rerank_snippet",
        "source || ':' || 1 || '-' || len(string_split(text, chr(10))) || chr(10) || 'Summary: ' || substr(lang, 1, 200) || chr(10) || '```' || chr(10) || substr(array_to_string(list_slice(string_split(text, chr(10)), 1, 30), chr(10)), 1, 800 - length(source || ':' || 1 || '-' || len(string_split(text, chr(10)))) - length('xSummary: ' || substr(lang, 1, 200)) - 9) || chr(10) || '```'",
        lambda: T.snippet(F.col("source"), F.lit(1), F.size(T.lines(F.col("text"))), F.col("lang"), F.col("text")),
    ),
):
    _text_query(_name, _sql, _build)
_text_query("path_extension", "CASE WHEN contains(url, '.') THEN lower(list_last(string_split(url, '.'))) ELSE '' END", lambda: T.extension(F.col("url")), "value", "pages", "page_id")
_text_query("generated_filter", "(ends_with(n, '.pb.go') OR ends_with(n, '_mock.go') OR starts_with(n, 'zz_generated.') OR contains(n, 'generated') OR contains(n, 'mocks') OR contains(lower(substr(html, 1, 1000)), 'code generated') OR contains(lower(substr(html, 1, 1000)), 'do not edit'))".replace("(n,", "(lower(list_last(string_split(url, '/'))),"), lambda: T.is_generated(F.col("url"), F.col("html")), "value", "pages", "page_id")


# Packs, windows and quality ----------------------------------------------------------------


@query("SELECT source, lang, n, place FROM (SELECT source, lang, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang)::INT AS place FROM documents GROUP BY 1, 2) WHERE place <= 3")
def router_languages(spark, sf_dir):
    return packs.top_values(table(spark, sf_dir, "documents"), "source", "lang", 3)


@query(f"""SELECT source, term, n, place FROM (SELECT source, term, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, term)::INT AS place
           FROM (SELECT source, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9_]+'), lambda t: length(t) >= 3 AND t NOT IN ({", ".join(f"'{s}'" for s in T.STOPWORDS)})))) AS term FROM documents) GROUP BY 1, 2) WHERE place <= 20""")
def symbol_histogram(spark, sf_dir):
    """The 20 tokens found in most chunks of each repository."""
    terms = table(spark, sf_dir, "documents").select("source", F.explode(T.meaningful(F.col("text"))).alias("term"))
    return packs.top_values(terms, "source", "term", 20)


@query("""SELECT source, doc_id, score FROM (SELECT source, doc_id, round(sqrt(n_chars) + len(string_split(text, chr(10))), 6) AS score, row_number() OVER (PARTITION BY source ORDER BY round(sqrt(n_chars) + len(string_split(text, chr(10))), 6) DESC, doc_id) AS p FROM documents) WHERE p <= 12""")
def important_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.round(F.sqrt("n_chars") + F.size(T.lines(F.col("text"))), 6).alias("score"))
    return fusion.diversify(docs, "source", "doc_id", 12)


@query("SELECT source, doc_id, n_chars FROM (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents) WHERE before <= 20000")
def excerpts_running_limit(spark, sf_dir):
    return packs.excerpts(table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", ["doc_id"], F.col("n_chars"), 20000)


@query("SELECT doc_id, source, lag(doc_id) OVER w AS prev_id, lead(doc_id) OVER w AS next_id FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)")
def neighbours(spark, sf_dir):
    return packs.neighbours(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", ["doc_id"])


@query("SELECT CASE WHEN n_chars < 100 THEN 'tiny' WHEN n_chars < 500 THEN 'small' WHEN n_chars < 2000 THEN 'medium' WHEN n_chars < 8000 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS n, round(avg(n_chars), 6) AS mean FROM documents GROUP BY 1")
def token_buckets(spark, sf_dir):
    c = F.col("n_chars")
    bucket = F.when(c < 100, "tiny").when(c < 500, "small").when(c < 2000, "medium").when(c < 8000, "large").otherwise("huge")
    return table(spark, sf_dir, "documents").groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"))


@query("SELECT lang, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY lang ORDER BY n DESC, lang LIMIT 10")
def kind_distribution(spark, sf_dir):
    n = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.desc("n"), "lang").limit(10)


@query("""SELECT * FROM (SELECT 'tiny' AS issue, count_if(n_chars < 50) AS n FROM documents UNION ALL SELECT 'huge', count_if(n_chars > 8000) FROM documents UNION ALL SELECT 'one_line', count_if(NOT contains(text, chr(10))) FROM documents UNION ALL SELECT 'empty', count_if(length(text) = 0) FROM documents) WHERE n > 0""")
def quality_issues(spark, sf_dir):
    return packs.unpivoted_counts(table(spark, sf_dir, "documents"), tiny=F.col("n_chars") < 50, huge=F.col("n_chars") > 8000, one_line=~F.contains(F.col("text"), F.lit("\n")), empty=F.length("text") == 0)


@query("SELECT doc_id, (pos - 1) // 5 AS block, (min(pos) - 1)::INT AS start_line, (max(pos) - 1)::INT AS end_line, string_agg(line, chr(10) ORDER BY pos) AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY 1, 2")
def fixed_blocks(spark, sf_dir):
    """Blocks of five lines, cut within the row: no shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.lines(F.col("text")).alias("l"))
    blocks = docs.select("doc_id", "l", F.explode(F.expr("sequence(0L, (size(l) - 1) div 5)")).alias("block"))
    first = (F.col("block") * 5).cast("int")
    return blocks.select("doc_id", "block", first.alias("start_line"), F.least(first + 4, F.size("l") - 1).alias("end_line"), F.array_join(F.slice("l", first + 1, F.lit(5)), "\n").alias("text"))


@query("""WITH a AS (SELECT o_custkey AS file, o_orderkey AS key, (o_orderkey % 100)::INT AS start_line, (o_orderkey % 100 + 20)::INT AS end_line FROM orders),
          b AS (SELECT o_custkey AS file, o_orderkey AS r_key, (o_orderkey % 90)::INT AS r_start, (o_orderkey % 90 + 30)::INT AS r_end FROM orders),
          j AS (SELECT a.file, key, r_key, least(end_line, r_end) - greatest(start_line, r_start) + 1 AS overlap FROM a JOIN b ON a.file = b.file AND r_start <= end_line AND r_end >= start_line)
          SELECT file, key, r_key, overlap FROM (SELECT *, row_number() OVER (PARTITION BY file, key ORDER BY overlap DESC, r_key) AS p FROM j) WHERE p = 1""")
def line_overlap_best(spark, sf_dir):
    """Interval join within a file: the range with the largest overlap."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("k"))
    span = lambda m, w: ((F.col("k") % m).cast("int"), (F.col("k") % m + w).cast("int"))
    (a, b), (c, d) = span(100, 20), span(90, 30)
    return packs.best_overlap(o.select("file", F.col("k").alias("key"), a.alias("start_line"), b.alias("end_line")), o.select("file", F.col("k").alias("r_key"), c.alias("r_start"), d.alias("r_end")), "file", "key")


@query("""WITH s AS (SELECT source, list(doc_id ORDER BY doc_id) FILTER (WHERE doc_id % 2 = 0) AS a, list(doc_id ORDER BY doc_id) FILTER (WHERE doc_id % 3 = 0) AS b FROM documents GROUP BY source)
          SELECT source, round(CASE WHEN len(coalesce(a, [])) + len(coalesce(b, [])) = 0 THEN 1.0 ELSE len(list_intersect(coalesce(a, []), coalesce(b, [])))::DOUBLE / len(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) END, 9) AS jaccard FROM s""")
def jaccard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    flags = docs.select("source", (F.col("doc_id") % 2 == 0).alias("a"), (F.col("doc_id") % 3 == 0).alias("b"))
    both, either = F.count_if(F.col("a") & F.col("b")), F.count_if(F.col("a") | F.col("b"))
    return flags.groupBy("source").agg(F.round(F.when(either == 0, 1.0).otherwise(both / either), 9).alias("jaccard"))


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings), k AS (SELECT r.*, (d.quality IS NOT NULL AND d.quality = 1)::INT AS rel FROM r LEFT JOIN labels d ON r.vec_id = d.doc_id WHERE rank <= 10)
          SELECT label, round(avg(rel), 9) AS precision_at_10 FROM k GROUP BY label""")
def precision_at_k(spark, sf_dir):
    ranked = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")).alias("rank")).where("rank <= 10")
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"), F.lit(1).alias("rel"))
    return ranked.join(good, "vec_id", "left").groupBy("label").agg(F.round(F.avg(F.coalesce("rel", F.lit(0))), 9).alias("precision_at_10"))


@query("""WITH e AS (SELECT user_id, event_id, ts, props, ts + INTERVAL 1 DAY AS expires_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events), m AS (SELECT max(ts) AS now FROM events)
          SELECT user_id, event_id, props, expires_at > now AS hit FROM e CROSS JOIN m WHERE p = 1""")
def ttl_lookup(spark, sf_dir):
    """Newest cache entry of each key, and whether it is still valid at the time of the last event."""
    e = table(spark, sf_dir, "events")
    newest = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "props")).alias("x")).select("user_id", "x.*")
    now = e.agg(F.max("ts").alias("now"))
    return newest.crossJoin(F.broadcast(now)).select("user_id", "event_id", "props", (F.col("ts") + F.expr("INTERVAL 1 DAY") > F.col("now")).alias("hit"))  # one row


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND o.doc_id = d.doc_id AND sha1(o.text) = sha1(d.text))")
def incremental_skip(spark, sf_dir):
    """Rows whose id and content hash aren't in the manifest (here: the even ids)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.col("text").cast("binary")).alias("sha"))
    return docs.join(docs.where("doc_id % 2 = 0"), ["doc_id", "sha"], "left_anti").select("doc_id")


@query("""SELECT conv_id, round(count_if(cited)::DOUBLE / count(*), 9) AS ratio, count_if(cited)::DOUBLE / count(*) >= 0.8 AS valid FROM (SELECT conv_id, ends_with(trim(line), '.') AS cited FROM (SELECT conv_id, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE length(trim(line)) > 0) GROUP BY conv_id""")
def citation_ratio(spark, sf_dir):
    """Share of non-blank lines with the required ending, and whether it reaches 0.8."""
    per_turn = table(spark, sf_dir, "conversations").select("conv_id", F.filter(F.transform(T.lines(F.col("text")), lambda x: F.trim(x)), lambda x: F.length(x) > 0).alias("l"))
    per_turn = per_turn.select("conv_id", F.size("l").alias("n"), F.size(F.filter("l", lambda x: F.endswith(x, F.lit(".")))).alias("c"))
    return per_turn.groupBy("conv_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).where("n > 0").select("conv_id", F.round(F.col("c") / F.col("n"), 9).alias("ratio"), (F.col("c") / F.col("n") >= 0.8).alias("valid"))


@query(f"""SELECT conv_id, 'EVIDENCE' || chr(10) || '--------' || chr(10) || string_agg('[' || p || '] ' || conv_id || ' |  | L' || turn || '–' || turn || ' |  (/' || coalesce(role, 'n/a') || ')' || chr(10) || 'code:' || chr(10) || '```' || chr(10)
           || CASE WHEN length(code) > 10000 THEN substr(code, 1, 10000) || chr(10) || '// … trimmed due to size …' ELSE code END || chr(10) || '```' || chr(10), chr(10) ORDER BY p) AS evidence
           FROM (SELECT *, {_S.format("coalesce(text, '')")} AS code, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations) WHERE p <= 12 GROUP BY conv_id""")
def evidence_block(spark, sf_dir):
    """Evidence blocks over whole turns, at most 12 items: code up to 10,000 characters, then a mark."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    absent = {c: _none() for c in ("rel_path", "primary_symbol", "primary_kind", "summary_en", "language")}
    chunks = turns.withColumns(absent | {"repo_id": F.col("conv_id"), "start_line": F.col("turn"), "end_line": F.col("turn"), "all_roles": F.array_compact(F.array("role"))})
    return packs.evidence(chunks, "conv_id", ["turn"])


@query("SELECT conv_id, turn FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM conversations) WHERE total <= 1000")
def prompt_budget(spark, sf_dir):
    """The greedy prefix of blocks within a budget of characters."""
    blocks = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return packs.budgeted(blocks, "conv_id", ["turn"], F.col("n"), 1000).select("conv_id", "turn")


@query(f"""WITH l AS (SELECT source, string_agg(lang, ', ' ORDER BY place) AS languages FROM ({ORACLES["router_languages"]}) GROUP BY source),
           t AS (SELECT source, string_agg(term, ', ' ORDER BY place) AS key_symbols FROM ({ORACLES["symbol_histogram"]}) GROUP BY source)
           SELECT source, substr('Repository ' || source, 1, 80) AS title, languages, key_symbols FROM l LEFT JOIN t USING (source)""")
def router_v1_pack(spark, sf_dir):
    """Router documents: title, summary, languages, modules and top tokens of each repository."""
    docs = table(spark, sf_dir, "documents")
    langs = packs.top_values(docs, "source", "lang", 3).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "lang"))).alias("l"))
    terms = packs.top_values(docs.select("source", F.explode(T.meaningful(F.col("text"))).alias("term")), "source", "term", 20).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    joined = langs.join(terms, "source", "left")
    names = lambda c, f: F.array_join(F.transform(c, lambda s: s[f]), ", ")
    return joined.select("source", F.substring(F.concat(F.lit("Repository "), "source"), 1, 80).alias("title"), names(F.col("l"), "lang").alias("languages"), names(F.col("t"), "term").alias("key_symbols"))
