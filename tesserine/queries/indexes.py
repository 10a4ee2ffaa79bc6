"""Queries over stored indexes, logs and sinks, source files and chunks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesserine.functions import chunkers
from tesserine.operators import ann, declarations, sink
from tesserine.plans import ingest, report
from tesserine.plans.staging import scratch
from tesserine.queries.registry import _KNN, QVEC, query, table
from tesserine.streaming import cache, upsert

#: The recall that the number of lists read is chosen for.
TARGET = 0.93


def vector_index(spark, sf_dir):
    """The index of the embeddings, built anew: a table may have changed since."""
    path = scratch(spark, "vector-index")
    ann.build(table(spark, sf_dir, "embeddings"), path, keep=["label"])
    return ann.VectorIndex(spark, path)


@query(_KNN.format(50))
def ann_all_lists(spark, sf_dir):
    """With every list probed the index gives the exact ranking."""
    index = vector_index(spark, sf_dir)
    return index.near(QVEC, 50, probes=len(index.means)).withColumnRenamed("key", "vec_id")


@query(_KNN.format(25).replace("FROM embeddings", "FROM embeddings WHERE label IN (1, 3)"))
def ann_filtered(spark, sf_dir):
    """A filter before the ranking, all lists."""
    index = vector_index(spark, sf_dir)
    return index.near(QVEC, 25, len(index.means), F.col("label").isin(1, 3)).withColumnRenamed("key", "vec_id")


_SOUND = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(f"""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE {_SOUND})
  SELECT query_id, rank, key, score FROM (SELECT query_id, key, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key)::INT AS rank
    FROM (SELECT q.vec_id AS query_id, c.vec_id AS key, round(list_inner_product(q.x, c.x), 6) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)) WHERE rank <= 10""")
def ann_batch(spark, sf_dir):
    """Every fiftieth vector as a query against all others, all lists."""
    index = vector_index(spark, sf_dir)
    return index.search(_asked(spark, sf_dir), 10, len(index.means), skip_self=True)


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(f"SELECT count(*) AS queries, 'at least 0.9' AS recall FROM embeddings WHERE vec_id % 50 = 0 AND {_SOUND}")
def ann_recall(spark, sf_dir):
    """Recall at 50 over every fiftieth vector, with as many lists as other vectors needed for it, against all lists."""
    index = vector_index(spark, sf_dir)
    other = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 25").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = index.calibrate(other, 50, TARGET)
    few, whole = (index.search(_asked(spark, sf_dir), 50, n) for n in (probes, len(index.means)))
    measured = ann.recall(few, whole)
    return measured.select("queries", F.when(F.col("recall") >= 0.9, "at least 0.9").otherwise(F.col("recall").cast("string")).alias("recall"))


# Chunks and declarations -------------------------------------------------------------------

#: Line items stand for chunks and orders for declarations of 300 files.
_D = """SELECT (o_custkey % 300)::INT AS file, o_orderkey AS ordinal, CASE o_orderkey % 4 WHEN 0 THEN 'method' WHEN 1 THEN 'type' ELSE 'function' END AS kind, 'N' || (o_orderkey % 50) AS name,
  CASE WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_orderkey % 8 = 0 THEN 's *T' ELSE 's T' END END AS receiver, CASE o_orderkey % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'N' || (o_orderkey % 50) END AS type_name,
  CASE WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'struct' ELSE 'alias' END END AS type_kind, 1000 + (o_orderkey * 37) % 60000 AS d_start, 1000 + (o_orderkey * 37) % 60000 + (o_orderkey * 11) % 900 AS d_end FROM orders"""
_C = "SELECT DISTINCT (l_orderkey % 300)::INT AS file, l_orderkey * 10 + l_linenumber AS chunk, (l_orderkey * 53 + l_linenumber * 401) % 62000 AS start, (l_orderkey * 53 + l_linenumber * 401) % 62000 + (l_partkey * 7) % 1500 AS \"end\" FROM lineitem"
_ROLE = """CASE WHEN kind = 'type' THEN 'declaration' WHEN CASE WHEN d_end > d_start THEN ("end" - start) / (d_end - d_start) * 100 ELSE 100 END > 85 THEN 'complete'
  WHEN start - d_start >= 30 THEN 'body' WHEN CASE WHEN d_end > d_start THEN ("end" - start) / (d_end - d_start) * 100 ELSE 100 END < 15 AND "end" - start < 200 THEN 'signature' ELSE 'mixed' END"""


def _agg(value: str) -> str:
    return f"string_agg({value}, ',' ORDER BY d_start, ordinal)"


@query(f"""WITH d AS ({_D}), c AS ({_C}), h AS (SELECT file, 900 AS header_end, min(d_start) AS first_declaration FROM d GROUP BY file),
  m AS (SELECT c.*, d.* EXCLUDE (file), {_ROLE} AS role, least("end", d_end) - greatest(start, d_start) AS shared FROM c JOIN d ON c.file = d.file AND "end" > d_start AND start < d_end),
  g AS (SELECT file, chunk, start, "end", count(*) AS n, {_agg("name")} AS all_symbols, {_agg("role")} AS all_roles, {_agg("d_start")} AS all_starts,
    {_agg("CASE kind WHEN 'method' THEN 'go:method:' || CASE WHEN contains(receiver, '*') THEN '(*T).' ELSE '(T).' END || name || '/' || role WHEN 'function' THEN 'go:function:' || name || '/' || role ELSE 'go:type:' || name || ' (' || type_kind || ')' END")} AS all_ast_paths,
    arg_min(name, (-shared, d_start, ordinal)) AS primary_symbol, arg_min(ordinal, (-shared, d_start, ordinal)) AS best, list(ordinal ORDER BY d_start, ordinal) AS ordinals FROM m GROUP BY file, chunk, start, "end")
  SELECT c.file, c.chunk, CASE WHEN n IS NULL AND start < greatest(header_end, first_declaration - 1) AND (least("end", greatest(header_end, first_declaration - 1)) - start > ("end" - start) * 0.3 OR "end" <= greatest(header_end, first_declaration - 1)) THEN true ELSE false END AS is_header,
    coalesce(primary_symbol, '') AS primary_symbol, (list_position(ordinals, best) - 1)::INT AS primary_index, coalesce(n, 0) > 1 AS is_multi_declaration, all_symbols, all_roles, all_starts, all_ast_paths
  FROM c LEFT JOIN g USING (file, chunk, start, "end") LEFT JOIN h USING (file) WHERE "end" > start""")
def chunk_declarations(spark, sf_dir):
    """Every declaration that a chunk overlaps, in source order, with roles, and the largest overlap as the primary one."""
    for name in ("orders", "lineitem"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    spans = spark.sql(_D.replace("::INT", ""))
    chunks = spark.sql(_C.replace('"end"', "`end`").replace("::INT", "")).where("`end` > start")
    headers = spans.groupBy("file").agg(F.lit(900).alias("header_end"), F.min("d_start").alias("first_declaration"))
    found = declarations.locate(chunks, spans, headers, lists=("all_symbols", "all_roles", "all_start_bytes", "all_ast_paths"), joined=",")
    return found.select(F.col("file").cast("int").alias("file"), "chunk", "is_header", "primary_symbol", "primary_index", "is_multi_declaration", "all_symbols", "all_roles", F.col("all_start_bytes").alias("all_starts"), "all_ast_paths")


# Source files ------------------------------------------------------------------------------

LIMIT = 100
#: An order stands for a Go file: one function a line item, whose body has as many lines as its quantity.
_GO = """concat('package orders\\n\\nimport "time"\\n\\n', array_join(transform(array_sort(collect_list(struct(l_linenumber AS n, int(l_quantity) AS q))),
  f -> concat('func F', f.n, '(x int) int {\\n', repeat(concat('\\tx += ', f.n, '\\n'), f.q), '\\treturn x\\n}\\n')), '\\n'))"""


def go_files(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").where("l_linenumber IS NOT NULL AND l_quantity IS NOT NULL").select("l_orderkey", "l_linenumber", "l_quantity")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = items.repartition(tasks, "l_orderkey").groupBy("l_orderkey")  # small rows, long walks: the items are dealt out, not their texts
    return files.agg(F.expr(_GO).alias("text")).selectExpr("concat('o', l_orderkey, '.go') AS rel_path", "text")


_UNIT = f"""SELECT l_orderkey, l_linenumber AS n, l_quantity::INT AS q, (5 + coalesce(sum(l_quantity::INT + 4) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line,
  CASE WHEN 11 + 4 * l_quantity::INT > {LIMIT} THEN (l_quantity::INT + 3 + 14) // 15 ELSE 1 END AS parts FROM lineitem"""
_PARTS = f"""SELECT *, CASE WHEN parts = 1 THEN line ELSE line + 15 * (p - 1) END AS first, CASE WHEN parts = 1 THEN line + q + 2 ELSE least(line + 15 * p - 1, line + q + 2) END AS last
  FROM (SELECT *, unnest(range(1, parts + 1)) AS p FROM ({_UNIT}))"""


@query(f"""WITH c AS (SELECT 'o' || l_orderkey || '.go' AS rel_path, 'header' AS node_kind, NULL AS name, 1 AS start_line, 3 AS end_line, 0 AS part, 6 AS n_tokens, 'go:file_header' AS ast_path, 'package orders' || chr(10) || 'import "time"' AS header_context FROM (SELECT DISTINCT l_orderkey FROM lineitem)
    UNION ALL SELECT 'o' || l_orderkey || '.go', 'function', 'F' || n, first, last, CASE WHEN parts > 1 THEN p ELSE 0 END,
      CASE WHEN first = line THEN 8 ELSE 0 END + 4 * greatest(0, least(last, line + q) - greatest(first, line + 1) + 1) + CASE WHEN line + q + 1 BETWEEN first AND last THEN 2 ELSE 0 END + CASE WHEN last = line + q + 2 THEN 1 ELSE 0 END,
      'go:function:F' || n || CASE WHEN parts > 1 THEN '#part' || p || '_block' || p ELSE '' END, 'package orders' FROM ({_PARTS}))
  SELECT rel_path, node_kind, name, start_line::INT AS start_line, end_line::INT AS end_line, part::INT AS part, n_tokens::INT AS n_tokens, ast_path, header_context,
    (row_number() OVER w - 1)::INT AS chunk_number, lag(start_line) OVER w IS NULL AS first, lead(start_line) OVER w IS NULL AS last FROM c WINDOW w AS (PARTITION BY rel_path ORDER BY start_line)""")
def go_chunks(spark, sf_dir):
    """Go files of every order cut by declarations, long functions by logical lines, with the header they repeat."""
    found = ingest.go_chunks(go_files(spark, sf_dir), "repo", LIMIT)
    return found.select(
        "rel_path", "node_kind", "name", "start_line", "end_line", "part", "n_tokens", "ast_path", "header_context", "chunk_number", F.col("prev").isNull().alias("first"), F.col("next").isNull().alias("last")
    )


@query(f"""WITH b AS (SELECT l_orderkey, line, q, parts, lead(line) OVER w AS next_line, 11 + 4 * q AS size FROM ({_UNIT}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY n))
  SELECT 'o' || l_orderkey || '.go' AS rel_path, sum(size)::BIGINT + 6 AS tokens, true AS within FROM b GROUP BY l_orderkey""")
def packed_go_chunks(spark, sf_dir):
    """Neighbouring declarations merged up to the limit: no token is lost, and none is over."""
    files = go_files(spark, sf_dir).select("rel_path", F.inline(chunkers.packed_code_chunks(F.col("text"), F.lit("go"), LIMIT)))
    n = F.regexp_count("text", F.lit(r"\w+|[^\w\s]"))
    return files.groupBy("rel_path").agg(F.sum(n).alias("tokens"), F.bool_and(n <= LIMIT).alias("within"))


# Profiles, logs and sinks ------------------------------------------------------------------

_PROFILED = "doc_id, lang AS language, CASE doc_id % 7 WHEN 0 THEN 'go:file_header' WHEN 1 THEN 'go:type:T (struct)' WHEN 2 THEN 'go:type:I (interface)' WHEN 3 THEN 'go:function:F' WHEN 4 THEN 'go:method:(T).M' WHEN 5 THEN NULL ELSE 'go:block' END AS ast_path, CASE WHEN doc_id % 11 <> 0 THEN n_chars // 10 END AS n_tokens, source"


@query(f"""WITH d AS (SELECT {_PROFILED} FROM documents), t AS (SELECT *, coalesce(n_tokens, 0) AS n, coalesce(ast_path, '') AS p FROM d),
  x AS (SELECT n, 'all' AS dimension, '' AS value FROM t UNION ALL SELECT n, 'language', coalesce(language, 'unknown') FROM t UNION ALL SELECT n, 'path', p FROM t
    UNION ALL SELECT n, 'bucket', CASE WHEN n < 50 THEN 'under_50' WHEN n < 100 THEN '50_100' WHEN n < 200 THEN '100_200' WHEN n < 300 THEN '200_300' ELSE 'over_300' END FROM t
    UNION ALL SELECT n, 'form', CASE WHEN p = 'go:file_header' THEN 'file_headers' WHEN contains(p, 'interface') THEN 'interfaces' WHEN contains(p, 'struct') THEN 'structs' WHEN contains(p, 'function') THEN 'functions' WHEN contains(p, 'method') THEN 'methods' END FROM t
    UNION ALL SELECT n, 'with', 'imports' FROM t WHERE source IS NOT NULL UNION ALL SELECT n, 'with', 'neighbor' FROM t WHERE doc_id % 3 = 0 UNION ALL SELECT n, 'with', 'summary' FROM t WHERE doc_id % 2 = 0
    UNION ALL SELECT n, 'import', source FROM t)
  SELECT dimension, value, count(*) AS chunks, sum(n)::BIGINT AS tokens, round(avg(n), 6) AS mean, min(n)::BIGINT AS least, max(n)::BIGINT AS most, quantile_disc(n, 0.5)::BIGINT AS median, quantile_disc(n, 0.9)::BIGINT AS p90 FROM x WHERE value IS NOT NULL GROUP BY 1, 2""")
def chunk_profile(spark, sf_dir):
    """All distributions of the chunk report in one scan."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf_dir, "documents").selectExpr(*[c.strip() for c in _PROFILED.replace("n_chars // 10", "n_chars div 10").split(", ")]).select(
        "language", "ast_path", "n_tokens", F.when(F.col("source").isNotNull(), F.array("source")).alias("imports_used"), F.array().cast("array<string>").alias("symbols_referenced"),
        F.when(F.col("doc_id") % 3 == 0, "x").alias("prev"), none.alias("next"), F.when(F.col("doc_id") % 2 == 0, "s").otherwise("").alias("summary_1l"), none.alias("qa_terms"),
    )
    return report.profile(rows)


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events WHERE user_id IS NOT NULL) WHERE p = 1")
def compacted_log(spark, sf_dir):
    """Events in eight batches by hash, compacted after every other one and as a whole: one run is read, without merging."""
    events = table(spark, sf_dir, "events")
    log = upsert.UpsertLog(spark, scratch(spark, "log"), events.schema, "user_id", "ts", "event_id", buckets=8)
    for number in range(8):
        log.append(events.where(F.pmod(F.xxhash64("event_id"), F.lit(8)) == number), number)
        if number % 2:
            log.compact(fanout=2)
    log.compact(whole=True)
    return log.read().select("user_id", "event_id", "value")


def _letters():
    """A stand-in for a model: length and number of a's; it can't take texts of more than 4000 characters, nor any that begins with Q."""

    def model(texts):
        if any(len(t) > 4000 or t.startswith("Q") for t in texts):
            raise MemoryError("too much")
        return [[float(len(t)), float(t.count("a"))] for t in texts]

    return model


_CUT = "CASE WHEN length(coalesce(text, '')) > 4000 THEN 2000 ELSE 30000 END"


@query(f"SELECT doc_id, CASE WHEN starts_with(coalesce(text, ''), 'Q') THEN NULL ELSE {_CUT} END AS cap, CASE WHEN NOT starts_with(coalesce(text, ''), 'Q') THEN least(length(coalesce(text, '')), {_CUT})::DOUBLE END AS length, CASE WHEN NOT starts_with(coalesce(text, ''), 'Q') THEN (length(left(coalesce(text, ''), {_CUT})) - length(replace(left(coalesce(text, ''), {_CUT}), 'a', '')))::DOUBLE END AS n_a FROM documents")
def embedding_sink(spark, sf_dir):
    """Documents embedded into a table by windows, in two runs; texts that fail get a smaller cap alone, the rest are dead letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    store = sink.EmbeddingSink(spark, scratch(spark, "sink"), docs.schema, "doc_id")
    store.run(docs.where("doc_id % 3 = 0"), _letters, windows=2, caps=(30_000, 2_000))
    store.run(docs, _letters, windows=2, caps=(30_000, 2_000))
    vectors = store.vectors().select("doc_id", "cap", F.get("embedding", F.lit(0)).cast("double").alias("length"), F.get("embedding", F.lit(1)).cast("double").alias("n_a"))
    none = F.lit(None).cast("double")
    return vectors.unionByName(store.dead_letters().select("doc_id", F.lit(None).cast("int").alias("cap"), none.alias("length"), none.alias("n_a")))


@query("""WITH e AS (SELECT user_id, event_id AS seq, ts, event_id % 3 = 0 AS puts, props FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
  w AS (SELECT *, last_value(CASE WHEN puts THEN {'ts': ts, 'v': props} END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM e),
  g AS (SELECT *, coalesce(s.v IS NOT NULL AND ts < s.ts + INTERVAL 2 HOUR, false) AS hit FROM w WHERE NOT puts)
  SELECT user_id::VARCHAR AS cache_key, seq, hit, CASE WHEN hit THEN s.v END AS value, (sum(hit::INT) OVER o)::BIGINT AS hits, (sum((NOT hit)::INT) OVER o)::BIGINT AS misses FROM g WINDOW o AS (PARTITION BY user_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def ttl_cache_stream(spark, sf_dir):
    """Events as a stream of cache operations: every third sets the user's entry for two hours, the others look it up."""
    folder = scratch(spark, "ttl")
    stream = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a stream source can't be a single file
    op = F.when(F.col("event_id") % 3 == 0, "set").otherwise("get")
    rows = stream.select(F.col("user_id").cast("string").alias("cache_key"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("at"), op.alias("op"), F.col("props").cast("string").alias("value"), F.lit(7_200_000).cast("long").alias("ttl_ms"))
    out = cache.lookups(rows).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema(cache.LOOKUP).parquet(f"{folder}/out").drop("at")
