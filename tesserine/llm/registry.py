"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import bpe, chat, fingerprints, langid, mixing, mtree, neardup, packing, runs, sharding, shared, substrings, warc, whitening


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles learned from the documents outside the held-out fold, applied to all."""
    docs = shared.read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    profiles = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs.select("doc_id", "held_out", "text"), profiles)


def op2_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2n (chosen) and 2n + 1 (rejected) as pair n."""
    turns = shared.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").withColumn("pair_id", F.shiftright("conv_id", 1))
    return chat.preference_pairs(turns.where("conv_id % 2 = 0"), turns.where("conv_id % 2 <> 0"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(shared.read_table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.with_copies(shared.read_table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(shared.read_table(spark, sf_dir, "documents"))


def op6_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shared.read_table(spark, sf_dir, "embeddings").select("vec_id", mtree.integer_vector(F.col("embedding")).alias("vector"))
    return mtree.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(shared.read_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(shared.read_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(shared.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.substring_dedup(docs, texts=False).withColumnRenamed("kept", "kept_sha256")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens; the other capacities are those that 1024 tokens imply."""
    return packing.packed_documents(shared.read_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shared.read_table(spark, sf_dir, "embeddings")
    return whitening.whiten(vectors.select("vec_id", whitening.integers(vectors["embedding"]).alias("x")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all texts; a tenth of the documents, by a hash of doc_id, is made periodic from some word on first."""
    docs = shared.read_table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))))
    docs = docs.withColumn("g", F.expr("h div 10")).withColumn("n", F.size("w").cast("long"))
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    rest = F.expr("slice(flatten(array_repeat(slice(w, int(a + 1), int(p)), int((n - a) div p + 1))), 1, int(n - a))")
    edited = F.concat_ws(" ", F.expr("slice(w, 1, int(a))"), rest)
    return runs.periodic_runs(docs.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text")), texts=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_language_id, op2_preference_pairs, op3_warc, op4_mixing, op5_order_minhash, op6_mtree_topk, op7_near_duplicates, op8_sharding, op9_bpe, op10_substring_dedup, op11_packing, op12_whitening, op13_periodic_runs)
}

_RENDER = "coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) FILTER ({}), '')"
_MASK = "coalesce(string_agg(CASE WHEN role = 'assistant' THEN '0*' || (13 + length(role)) || ',1*' || (length(text) + 11) ELSE '0*' || (24 + length(role) + length(text)) END, ',' ORDER BY pos) FILTER ({}), '')"

ORACLES: dict[str, str] = {
    "op2_preference_pairs": f"""
        WITH t AS (
          SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
          FROM conversations WHERE conv_id IS NOT NULL),
        same AS (
          SELECT c.pair_id, c.pos FROM t c JOIN t r ON c.pair_id = r.pair_id AND c.pos = r.pos AND c.side = 0 AND r.side = 1 AND c.role = r.role AND c.text = r.text),
        runs AS (SELECT pair_id, pos, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS i FROM same),
        prefix AS (SELECT pair_id, count(*) AS n FROM runs WHERE pos = i GROUP BY pair_id),
        u AS (SELECT t.*, coalesce(n, 0) AS n FROM t LEFT JOIN prefix USING (pair_id))
        SELECT pair_id, max(n) AS n_common,
          {_RENDER.format("WHERE side = 0 AND pos <= n")} AS prompt,
          {_RENDER.format("WHERE side = 0 AND pos > n")} AS chosen, {_MASK.format("WHERE side = 0 AND pos > n")} AS chosen_mask,
          {_RENDER.format("WHERE side = 1 AND pos > n")} AS rejected, {_MASK.format("WHERE side = 1 AND pos > n")} AS rejected_mask
        FROM u GROUP BY pair_id""",
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages),
        g AS (SELECT d, max(page_id) AS newest FROM p GROUP BY d),
        s AS (SELECT p.*, newest, [strpos('0123456789abcdef', x) - 1 for x in string_split(p.d, '')] AS n FROM p JOIN g USING (d))
        SELECT page_id, strlen(h) AS payload_bytes,
          array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((n[5 * i // 4 + 1] * 16 + n[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31), 1) for i in range(32)], '') AS payload_digest,
          CASE WHEN page_id < newest THEN 'revisit' ELSE 'response' END AS record_type,
          CASE WHEN page_id < newest THEN newest END AS refers_to
        FROM s""",
    "op4_mixing": r"""
        WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
        src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
        ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM src),
        w AS (SELECT *, ([3.0, 1.0, 2.0])[(place % 3 + 1)::INT]::DOUBLE AS weight, 2.0 * source_size::DOUBLE AS cap FROM ranked),
        l AS (SELECT *, (1.5 * sum(source_size) OVER ()::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        f AS (SELECT min_by(level, (cap / weight, place)) AS final FROM l WHERE level * weight <= cap),
        r AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END AS target FROM l CROSS JOIN f),
        d AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                     ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
              FROM sized JOIN r ON sized.source IS NOT DISTINCT FROM r.source)
        SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM d""",
    "op6_mtree_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024.0 * x::DOUBLE)::DOUBLE) AS x FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op7_near_duplicates": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, i, i + 4), ' ')) AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS MATERIALIZED (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
        both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        reach(x, y) AS (SELECT a, a FROM both_ways UNION SELECT r.x, b.b FROM reach r JOIN both_ways b ON r.y = b.a),
        comp AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON d.doc_id = comp.x""",
    "op10_substring_dedup": r"""
        WITH w AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
        s AS MATERIALIZED (SELECT doc_id, i, hash(array_to_string(list_slice(w, i, i + 12), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
        f AS (SELECT g, min(doc_id) AS first_doc FROM s GROUP BY g),
        hit AS (SELECT s.doc_id, s.i FROM s JOIN f USING (g) WHERE first_doc < s.doc_id),
        gone AS (SELECT DISTINCT doc_id, i + j AS i FROM hit, range(0, 13) t(j)),
        kept AS (SELECT u.doc_id, count(*) AS n_words, count(g.i) AS n_removed, coalesce(string_agg(u.word, ' ' ORDER BY u.i) FILTER (WHERE g.i IS NULL), '') AS rest
                 FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.i = g.i GROUP BY u.doc_id)
        SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)""",
}
