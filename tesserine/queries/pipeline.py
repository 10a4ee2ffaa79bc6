"""Queries of gates, rules, caches and streaming over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserine.functions import chunkers
from tesserine.operators import gates, models, rules
from tesserine.plans import ingest
from tesserine.plans.staging import scratch
from tesserine.queries.registry import query, table
from tesserine.streaming.upsert import UpsertLog

_HITS = "SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents"


def _hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return docs.select("source", "doc_id", "text", F.row_number().over(order).alias("rank"))


@query(f"SELECT source, count_if(contains(lower(text), 'license') OR contains(lower(text), 'permission')) >= 2 AS passes FROM ({_HITS}) WHERE rank <= 8 GROUP BY source")
def relevance_gate(spark, sf_dir):
    return gates.relevance(_hits(spark, sf_dir), ["license", "permission"], query="source")


@query(f"""WITH w AS (SELECT source, text, unnest(['software', 'license', 'zebra']) AS word FROM ({_HITS}) WHERE rank <= 10)
           SELECT source, count(DISTINCT word) FILTER (WHERE contains(lower(text), word)) AS n_found, count(DISTINCT word) FILTER (WHERE contains(lower(text), word)) >= 2 AS passes FROM w GROUP BY source""")
def evidence_overlap_gate(spark, sf_dir):
    hits = _hits(spark, sf_dir).withColumn("question", F.lit("which software license is the zebra"))
    return gates.evidence_overlap(hits, query="source")


@query("SELECT doc_id, (length(text) > 0 AND length(text) <= 160 AND NOT contains(text, chr(10)) AND NOT contains(text, chr(13)) AND NOT regexp_matches(text, '[^\\x00-\\x7F]')) AS value FROM documents")
def summary_valid(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.valid_summary(F.col("text")).alias("value"))


@query("SELECT doc_id, contains(lower(text), 'license') AND NOT contains(lower(coalesce(source, '')), 'license') OR contains(lower(text), 'password') AND NOT contains(lower(coalesce(source, '')), 'password') AS value FROM documents")
def forbidden_terms(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", gates.unfounded(F.col("text"), F.col("source"), F.lit(None).cast("string"), ["license", "password"]).alias("value"))


@query("SELECT conv_id, turn, coalesce((contains(lower(text), 'get') OR contains(lower(text), 'find')) AND (contains(lower(text), 'data') OR contains(lower(text), 'file')), false) AS value FROM conversations")
def intent_verb_noun(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", gates.contains_each(F.col("text"), ["get", "find"], ["data", "file"]).alias("value"))


@query("SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY b) - 1) AS block, b * 50 + 1 AS start_line, least(b * 50 + 50, len(l))::INT AS end_line FROM (SELECT page_id, l, unnest(range(0, (len(l) - 1) // 50 + 1)) AS b FROM (SELECT page_id, string_split(coalesce(html, ''), chr(10)) AS l FROM pages))")
def page_blocks(spark, sf_dir):
    """Blocks of 50 lines of every page."""
    files = table(spark, sf_dir, "pages").select(F.col("page_id").alias("rel_path"), F.col("html").alias("text"))
    rows = ingest.blocks(files)
    return rows.select(F.col("rel_path").alias("page_id"), ((F.col("start_line") - 1) / 50).cast("long").alias("block"), F.col("start_line").cast("long").alias("start_line"), "end_line")


@query("""WITH c AS (SELECT coalesce(source, 'none') AS path, coalesce(source, 'none') || '/' || doc_id AS chunk_id, doc_id, text FROM documents),
          w AS (SELECT *, lag(chunk_id) OVER p AS before, lead(chunk_id) OVER p AS after FROM c WINDOW p AS (PARTITION BY path ORDER BY doc_id))
          SELECT path, chunk_id, 'GO_HEADER_PRESENT_FIRST' AS code, 'No go:file_header chunk found' AS message FROM w
          UNION ALL SELECT path, chunk_id, 'GO_NEIGHBOR_CHAIN', 'prev should be ' || before || ', got null' FROM w WHERE before IS NOT NULL AND after IS NOT NULL
          UNION ALL SELECT path, chunk_id, 'GO_NEIGHBOR_CHAIN', 'next should be ' || after || ', got null' FROM w WHERE before IS NOT NULL AND after IS NOT NULL
          UNION ALL SELECT path, chunk_id, 'GO_NO_EMPTY_CHUNKS', 'Chunk text and core must not be empty' FROM w WHERE length(trim(coalesce(text, ''))) = 0""")
def chunk_rules(spark, sf_dir):
    """Violations of the chunk rules, with documents as chunks of their source."""
    name, none, empty = F.coalesce("source", F.lit("none")), F.lit(None).cast("string"), F.array().cast("array<string>")
    rows = table(spark, sf_dir, "documents").select(
        name.alias("path"), F.concat_ws("/", name, F.col("doc_id").cast("string")).alias("chunk_id"), F.col("doc_id").alias("start_line"), F.lit("go:function:Run").alias("ast_path"),
        "text", F.col("text").alias("core"), F.lit("package p").alias("header_context"), none.alias("qa_terms"), empty.alias("imports_used"), F.array(F.lit("Run")).alias("symbols_defined"),
        empty.alias("symbols_referenced"), F.struct(none.alias("prev"), none.alias("next")).alias("neighbors"),
    )
    return rules.violations(rows)


@query()
def code_chunks(spark, sf_dir):
    """Every page cut at its top-level JavaScript declarations. No SQL: the scan keeps state; tests hold it to known cuts."""
    rows = table(spark, sf_dir, "pages").select("page_id", chunkers.code_chunks(F.col("html"), F.lit("js")).alias("c"))
    return rows.select("page_id", F.inline("c"))


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events WHERE user_id IS NOT NULL) WHERE p = 1")
def stream_upsert(spark, sf_dir):
    """Events read as a stream and upserted by user: the newest event of each."""
    folder = scratch(spark, "upsert")
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, since a stream source can't be a single file
    log = UpsertLog(spark, f"{folder}/table", schema, "user_id", "ts", "event_id", buckets=8)
    log.attach(stream, f"{folder}/checkpoint").awaitTermination()
    return log.read().select("user_id", "event_id", "value")


@query("SELECT user_id, hit, CASE WHEN hit THEN value END AS value FROM (SELECT k.user_id, coalesce(ts + INTERVAL 1 DAY > TIMESTAMP '2024-01-15', false) AS hit, props AS value FROM (SELECT DISTINCT o_custkey AS user_id FROM orders) k LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS p FROM events) e ON e.user_id = k.user_id AND p = 1)")
def cache_lookup(spark, sf_dir):
    """Customers looked up in a cache of events that lasts a day."""
    cache = table(spark, sf_dir, "events").select("user_id", F.col("props").alias("value"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("expires_at"), F.struct("ts", "event_id").alias("created_at"))
    keys = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id")).distinct()
    return models.cached(keys, cache, F.lit("2024-01-15").cast("timestamp"), key="user_id").select("user_id", "hit", "value")
