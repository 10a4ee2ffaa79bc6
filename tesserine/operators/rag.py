"""Retrieval to answer as one plan: recall, filter, rerank, evidence, answer; and the search that feeds it.

hits and chunks are keyed by query and id; models are injected as factories (see models).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.text import close_fences, lines, provenance_id, rerank_snippet, safe_truncate, strip
from tesserine.operators import answers, filtering, fusion, models, packs, postings, vectors
from tesserine.operators.models import Factory
from tesserine.plans.staging import staged

#: Sizes of the search: kNN and BM25 candidates, the constant of the fusion, hits a file, hits in all, hits with text.
KNN, BM25, RRF, PER_FILE, TOP, WITH_TEXT = 50, 300, 60, 3, 16, 8
SCORED = "Rate from 0 (unrelated) to 4 (answers it) how well the code answers the question. Reply with JSON: {\"score\": 0-4, \"why\": \"up to ten words\"}."


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def relevant_lines(text: Column, most: int = 40) -> Column:
    """The first lines and a comment where some are left out."""
    rows = lines(text)
    return F.when(F.size(rows) > most, F.concat(F.array_join(F.slice(rows, 1, most), "\n"), F.lit("\n// ... (truncated)"))).otherwise(text)


def filter_text(text: Column, most: int = 1200) -> Column:
    """A chunk's text for the filter: line ends normalised, cut at a line or word, fences closed. Null counts as empty."""
    return close_fences(safe_truncate(unix_lines(F.coalesce(text, F.lit(""))), most))


def rerank_text(text: Column, doc_head: Column, most: int = 2000) -> Column:
    return F.substring(strip(F.coalesce(F.nullif(text, F.lit("")), doc_head, F.lit(""))), 1, most)


def bag(text: Column, symbols: Column, path: Column, symbol: Column) -> Column:
    """All words of a source in lower case."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.lower(F.concat_ws(" ", part(text), part(F.array_join(symbols, " ")), part(path), part(symbol)))


def filter_prompt(question: Column, path: Column, start: Column, end: Column, language: Column, summary: Column, text: Column, most: int = 1200) -> Column:
    """What the filter's model is asked about a chunk."""
    place = F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))
    about = F.when(F.length(summary) > 0, F.concat(F.lit("\nSummary: "), summary)).otherwise(F.lit(""))
    return F.concat(F.lit(SCORED + "\n\nQuestion: "), question, F.lit("\nFile: "), place, F.lit("\nLanguage: "), F.coalesce(language, F.lit("")), about, F.lit("\n```\n"), filter_text(text, most), F.lit("\n```"))


def survivors(rows: DataFrame, threshold: int = 3, least: int = 8, **options) -> DataFrame:
    """(query, id, lane, hybrid, filter_score, rank) of the rows that pass the filter; a query with fewer than ``least`` of them gets its first ``least`` recalled rows instead, at filter score 1.

    rows: query, id, rank (of the recall), retriever_score, filter_score.
    """
    kept = filtering.guarded(rows, "query", "id", threshold, least, **options).join(rows.select("query", "id", "filter_score"), ["query", "id"])
    enough = kept.groupBy("query").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("query")
    few = rows.join(enough, "query", "left_anti").where(F.col("rank") <= least)
    baseline = few.select("query", "id", F.lit("baseline").alias("lane"), F.lit(0.0).alias("hybrid"), F.lit(1).alias("filter_score"), F.col("rank").cast("int").alias("rank"))
    return kept.join(enough, "query", "left_semi").select(*baseline.columns).unionByName(baseline)


def evidence_rows(filtered: DataFrame, scores: DataFrame | None, chunks: DataFrame, k: int = 8) -> DataFrame:
    """The k chunks of each query that its evidence holds, with ``item``.

    scores: query, id, rerank_score; a chunk without one counts as 0. Without scores the
    filter's order stays. Ties go to the higher filter score, then the provenance id.
    """
    rows = filtered.join(chunks, ["query", "id"])
    order = ["rank"]
    if scores is not None:
        rows = rows.join(scores, ["query", "id"], "left").withColumn("rerank_score", F.coalesce("rerank_score", F.lit(0.0)))
        order = [F.desc("rerank_score"), F.desc("filter_score"), provenance_id(F.col("id"), F.col("chunk_hash"), F.col("text"))]
    return rows.withColumn("item", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("item") <= k)


def answered(questions: DataFrame, recalled: DataFrame, filter_model: Factory, rerank_model: Factory | None, answer_model: Factory, recall: int = 100, k: int = 8) -> DataFrame:
    """(query, answer, recalled, kept, evidence): the whole plan.

    questions: query, question. recalled: query, id, rank, retriever_score, repo_id, rel_path,
    start_line, end_line, language, text, summary_en, chunk_hash, primary_symbol, primary_kind,
    all_roles. A question without a recalled chunk is told so, without a model. Each step is
    written before the next reads it, so no model is asked twice about a row.
    """
    chunks = staged(recalled.where(F.col("rank") <= recall), "recalled")
    asked = chunks.join(questions, "query").withColumn("pair", F.concat_ws("\x1f", "query", F.col("id").cast("string")))
    prompt = filter_prompt(F.col("question"), F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("language"), F.col("summary_en"), F.col("text"))
    scored = models.filter_scores(asked.withColumn("prompt", prompt), filter_model, key="pair").select("pair", "filter_score")
    filtered = staged(survivors(staged(asked.join(scored, "pair").select("query", "id", "rank", "retriever_score", "filter_score"), "rated")), "filtered")
    scores = None
    if rerank_model is not None:
        text = rerank_snippet(F.col("rel_path"), F.col("start_line"), F.col("end_line"), F.col("summary_en"), F.col("language"), F.col("text"))
        pool = filtered.join(asked.drop("rank"), ["query", "id"]).select("query", "id", "rank", F.concat("question", F.lit("\n"), text).alias("pair_text"))
        scores = staged(models.rerank(pool, rerank_model, "query").select("query", "id", "rerank_score"), "scores")
    shown = evidence_rows(filtered, scores, chunks.drop("rank", "retriever_score"), k)
    evidence = staged(packs.evidence(shown.withColumnRenamed("item", "at"), "query", ["at"], k), "evidence")
    replies = answers.evidence_answers(questions, evidence, answer_model)
    counts = chunks.groupBy("query").agg(F.count("*").alias("recalled")).join(filtered.groupBy("query").agg(F.count("*").alias("kept")), "query", "left")
    out = questions.select("query").join(counts, "query", "left").join(replies.select("query", "answer"), "query", "left").join(evidence, "query", "left")
    return out.select("query", F.coalesce("answer", F.lit("No relevant chunks found to answer your question.")).alias("answer"), F.coalesce("recalled", F.lit(0)).alias("recalled"), F.coalesce("kept", F.lit(0)).alias("kept"), "evidence")


def routed(index: postings.Index, question: str, generation: str = "router_v1", most: int = 2) -> DataFrame:
    """(key, score): the repositories whose router documents match best."""
    return postings.fielded(index, generation, question).where("score > 0").orderBy(F.desc("score"), "key").limit(most)


def hybrid_search(chunks: DataFrame, embeddings: DataFrame, index: postings.Index | None, vector: Sequence[float], clauses: Sequence[tuple[str, str, float]], question: str, repos: Sequence[str] = (), language: str = "", identifiers: Sequence[str] = (), file_hints: Sequence[str] = (), semantic_only: bool = False, k: int = TOP, with_text: int | None = WITH_TEXT, fields: tuple[str, str] = ("summary_en", "text")) -> DataFrame:
    """Fused search: kNN and planned BM25 under the same filters, reciprocal ranks, boosts, a cap a file, the best k, text for the first ``with_text`` (None: all).

    chunks: id, repo_id, rel_path, language, primary_symbol, all_symbols, all_roles, text.
    embeddings: id, embedding. ``semantic_only`` needs no index. Returns the chunk's columns but text with score, rank and text.
    """
    kept = chunks.where(F.col("repo_id").isin(*repos)) if repos else chunks
    allowed = kept.where(F.col("language") == language) if language else kept
    near = embeddings.join(allowed.select("id"), "id", "left_semi") if repos or language else embeddings
    lists = [vectors.knn(near, vector, KNN, vec_id="id")]
    if not semantic_only:
        words = postings.planned(index, kept, "id", clauses, question, language, fields, BM25)
        lists.append(vectors.ranked(words.withColumnRenamed("key", "id"), "id"))
    fused = fusion.rrf(lists, "id", RRF)
    hits = kept.drop("text").join(fused.select("id", "score", "first_list", "first_rank"), "id")
    boosted = fusion.symbol_boosts(hits, list(identifiers), list(file_hints)).withColumn("score", F.round("score", 9))
    best = vectors.ranked(fusion.top(fusion.diversify(boosted, "rel_path", "id", PER_FILE), k, "id"), "id").drop("first_list", "first_rank")
    wanted = best if with_text is None else best.where(F.col("rank") <= with_text)
    texts = chunks.select("id", "text").join(F.broadcast(wanted.select("id")), "id")  # k rows at most
    return best.join(texts, "id", "left")


#: Tables by generation of routers and chunks.
ROUTERS = {"v1": "router_v1", "v2": "router_v2"}
CHUNKS = {"v2": "chunks_v2", "v3": "chunks_v3", "v4": "chunks_v4", "v5": "chunks_v5"}


def table_of(version: str, kind: str = "chunks") -> str:
    """The table of a version; raises for one that doesn't exist."""
    known = ROUTERS if kind == "router" else CHUNKS
    if version not in known:
        raise ValueError(f"no {kind} of version {version!r}; there are {', '.join(known)}")
    return known[version]


def lexical(index: postings.Index, question: str, keys: DataFrame, version: str = "v2", intents: Sequence[Sequence[str]] = (), topic: Sequence[str] = (), docs: DataFrame | None = None, fields: dict[str, float] | None = None) -> DataFrame:
    """The lexical query of a version: by intent where the question has a word of every group, guarded where it has a topic, else best fields.

    docs (key, rel_path) is needed for the paths of an intent.
    """
    low = question.lower()
    if intents and docs is not None and all(any(w in low for w in group) for group in intents):
        held = tuple(f for f in ("text", "symbols", "rel_path") if f in index.stats)
        return postings.by_intent(index, question, intents, docs.join(keys, "key", "left_semi"), "key", F.col("rel_path"), fields, held)
    if topic:
        return postings.guarded(index, question, topic, keys, fields, tuple(f for f in ("text", "symbols") if f in index.stats))
    return postings.search(should=[index.best_fields(fields or postings.FIELDS[version], question)], keys=keys)
