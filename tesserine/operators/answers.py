"""Answers from sources: order, prompt, repository context, spotlights, citation repair, and answers by an injected model.

sources: query, rank, repo_id, rel_path, start_line, end_line, code. Prompts of a query hold a
few sources, so they are put together per query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.functions.keywords import has_spotlight
from tesserine.functions.text import extension, lines, strip
from tesserine.operators.gates import has_citation, valid_answer
from tesserine.operators.models import Factory

NOT_FOUND = "Not found in provided sources."
INSTRUCTIONS = f"Answer from the sources only and end every statement with its citation [repo_id|rel_path:start-end]. If they don't hold the answer, reply: {NOT_FOUND}"
REPAIR = "Add citations [repo_id|rel_path:start-end] from the list of sources to each statement of the answer. Change nothing else."
NOTE = "\n\n# NOTE: Some sources were omitted to fit prompt size."


def is_test_source(path: Column) -> Column:
    low = F.lower(F.coalesce(path, F.lit("")))
    return F.contains(low, F.lit("tests")) | F.contains(low, F.lit("/test")) | F.startswith(low, F.lit("test_")) | F.endswith(low, F.lit("_test.py"))


def implementation_first(sources: DataFrame, most: int | None = None) -> DataFrame:
    """The sources with ``place``: tests after all others, each in the order of their ranks; at most ``most`` a query."""
    order = Window.partitionBy("query").orderBy(is_test_source(F.col("rel_path")), "rank")
    out = sources.withColumn("place", F.row_number().over(order))
    return out if most is None else out.where(F.col("place") <= most)


def spotlights(sources: DataFrame, k: int) -> DataFrame:
    """The first source of each path, then the first k of each query, with ``place``. A null path is a path of its own."""
    first = Window.partitionBy("query", "rel_path").orderBy("rank")
    kept = sources.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= k)


def clipped(code: Column, most: int) -> Column:
    """The first lines and a marker where some are left out."""
    rows = lines(F.coalesce(code, F.lit("")))
    return F.when(F.size(rows) > most, F.concat(F.array_join(F.slice(rows, 1, most), "\n"), F.lit("\n# …(trimmed)…"))).otherwise(F.coalesce(code, F.lit("")))


def _span() -> Column:
    end = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return F.concat(end("start_line"), F.lit("-"), end("end_line"))


def _place() -> Column:
    return F.concat_ws(" | ", "repo_id", "rel_path", F.concat(F.lit("lines "), _span()))


def _fenced(code: Column) -> Column:
    return F.concat(F.lit("```"), extension(F.coalesce("rel_path", F.lit(""))), F.lit("\n"), code, F.lit("\n```"))


def _in_order(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("place", column))), lambda x: x[column])


def prompts(questions: DataFrame, sources: DataFrame, topic: Sequence[str] = (), most_sources: int = 12, most_lines: int = 120, most_chars: int = 120_000, instructions: str = INSTRUCTIONS, context: str | None = None) -> DataFrame:
    """(query, prompt, n_kept): question, instructions, context, list of sources and their fenced code.

    Where the whole is longer than ``most_chars``, blocks are kept from the first on as long as
    they fit, and a note says so. questions: query, question and, if named, a text column ``context``.
    """
    rows = implementation_first(sources, most_sources).withColumn("line", F.concat(F.lit("[#"), F.col("place"), F.lit("] "), _place()))
    block = F.concat(F.lit("===== Source #"), F.col("place"), F.lit(": "), _place(), F.lit("\n"), _fenced(clipped(F.col("code"), most_lines)))
    gathered = rows.withColumn("block", block).groupBy("query").agg(F.array_join(_in_order("line"), "\n").alias("listed"), _in_order("block").alias("blocks"))
    asked = questions.join(gathered, "query", "left").withColumns({"listed": F.coalesce("listed", F.lit("")), "blocks": F.coalesce("blocks", F.array().cast("array<string>"))})
    known = F.when(F.length(F.col(context)) > 0, F.concat(F.lit("Repositories (not to be cited):\n"), F.col(context), F.lit("\n\n"))).otherwise(F.lit("")) if context else F.lit("")
    head = F.concat(F.lit("Question:\n"), strip(F.col("question")), F.lit(f"\n\n{instructions}\n\n"), known, F.lit("Sources:\n"), F.col("listed"), F.lit("\n\n"))
    check = F.lit(f"\n\nTopic check: unless a source has one of {', '.join(topic)}, reply: {NOT_FOUND}\n" if topic else "")
    whole = F.concat(head, F.array_join("blocks", "\n\n"), check)
    start = F.struct(F.length(head).alias("total"), F.lit(0).alias("n"), F.lit(False).alias("full"))
    step = lambda s, b: F.when(s["full"] | (s["total"] + F.length(b) + 2 > most_chars), F.struct(s["total"].alias("total"), s["n"].alias("n"), F.lit(True).alias("full"))).otherwise(F.struct((s["total"] + F.length(b) + 2).alias("total"), (s["n"] + 1).alias("n"), F.lit(False).alias("full")))
    kept = F.when(F.length(whole) > most_chars, F.aggregate("blocks", start, step)["n"]).otherwise(F.size("blocks"))
    fitted = F.concat(head, F.array_join(F.slice("blocks", F.lit(1), F.col("n_kept")), "\n\n"), F.when(F.col("n_kept") < F.size("blocks"), F.lit(NOTE)).otherwise(F.lit("")))
    return asked.withColumn("n_kept", kept).select("query", F.when(F.length(whole) > most_chars, fitted).otherwise(whole).alias("prompt"), "n_kept")


def guide_context(repo_id: Column, languages: Column, entrypoints: Column, modules: Column, overview: Column, key_flows: Column) -> Column:
    """The lines of a repository guide within a prompt."""
    named = F.coalesce(F.nullif(F.array_join(languages, ", "), F.lit("")), F.lit("unknown"))
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.lit("- "), repo_id, F.lit("\n  Languages: "), named, F.lit("  Entrypoints: "), part(entrypoints), F.lit("\n  Modules: "), part(modules), F.lit("\n  Overview: "), part(overview), F.lit("\n  Key Flows: "), part(key_flows))


def router_context(repo_id: Column, title: Column, languages: Column, modules: Column, symbols: Column, tech: Column, entrypoints: Column, domains: Column, summary: Column) -> Column:
    """The lines of a router document within a prompt."""
    named = F.coalesce(F.nullif(F.array_join(languages, ", "), F.lit("")), F.lit("unknown"))
    part = lambda label, c: F.concat(F.lit(label), F.coalesce(c, F.lit("")))
    return F.concat(
        F.lit("- "), repo_id, part(" | ", title), part("\n  Languages: ", named), part("\n  Modules: ", modules), part("\n  Symbols: ", symbols), part("\n  Tech: ", tech), part("  Entrypoints: ", entrypoints), part("  Domains: ", domains), part("\n  Summary: ", summary)
    )


def spotlight_section(sources: DataFrame, count: int = 3, most_lines: int = 15) -> DataFrame:
    """(query, spotlight): the section of code added to an answer that has none."""
    rows = spotlights(sources, count)
    cited = F.concat(F.lit("["), F.col("repo_id"), F.lit("|"), F.col("rel_path"), F.lit(":"), _span(), F.lit("]"))
    item = F.concat(F.lit("\n"), _place(), F.lit("\n"), _fenced(clipped(F.col("code"), most_lines)), F.lit("\n"), cited)
    return rows.withColumn("item", item).groupBy("query").agg(F.concat(F.lit("\n---\n**Spotlight (auto)**\n"), F.array_join(_in_order("item"), "\n")).alias("spotlight"))


def bundle(questions: DataFrame, hits: DataFrame, contexts: DataFrame, guides: DataFrame, most_lines: int = 120, version: str = "1.2") -> DataFrame:
    """(query, bundle): JSON of the question, its routed repositories with context and guides, and its numbered sources.

    hits: query, rank, repo_id, rel_path, start_line, end_line, chunk_number, score, text.
    contexts, guides: query, repo_id and the fields shown.
    """
    source = F.struct(F.col("rank").alias("idx"), "repo_id", "rel_path", "start_line", "end_line", "chunk_number", "score", clipped(F.col("text"), most_lines).alias("code"))
    gathered = lambda df, out: df.groupBy("query").agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != "query"]))).alias(out))
    sources = hits.groupBy("query").agg(F.array_sort(F.collect_list(source)).alias("sources"))
    rows = questions.join(sources, "query", "left").join(gathered(contexts, "repos"), "query", "left").join(gathered(guides, "repo_guides"), "query", "left")
    routed = F.transform("repos", lambda r: r["repo_id"]).alias("routed_repo_ids")
    return rows.select("query", F.to_json(F.struct(F.lit(version).alias("version"), F.col("question").alias("query"), routed, "repos", "repo_guides", "sources")).alias("bundle"))


def _asked(rows: DataFrame, factory: Factory, prompt: str, out: str) -> DataFrame:
    from pyspark.sql.types import StringType, StructType

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or factory()
            yield frame.assign(**{out: model([p or "" for p in frame[prompt]])})

    return rows.mapInPandas(run, StructType([*rows.schema.fields]).add(out, StringType()))


def repaired(answers: DataFrame, listed: str, factory: Factory) -> DataFrame:
    """Answers (query, answer, and the list of sources) with citations: an answer without any goes to the model once; an empty reply keeps it."""
    lacking = answers.where(~has_citation(F.col("answer"))).withColumn("prompt", F.concat(F.lit(f"{REPAIR}\n\nSources:\n"), F.col(listed), F.lit("\n\nAnswer:\n"), F.col("answer")))
    fixed = _asked(lacking, factory, "prompt", "reply").withColumn("answer", F.coalesce(F.nullif("reply", F.lit("")), "answer")).select(*answers.columns)
    return answers.where(F.coalesce(has_citation(F.col("answer")), F.lit(True))).unionByName(fixed)


def answered(questions: DataFrame, sources: DataFrame, factory: Factory, topic: Sequence[str] = (), guards: bool = True, spotlight: int = 3, **options) -> DataFrame:
    """(query, answer, valid): the model's answer to each prompt.

    With ``guards`` a question without a source isn't asked, and an answer whose statements
    aren't cited to four fifths is replaced by "Not found". An answer without a spotlight gets one.
    """
    asked = prompts(questions, sources, topic, **options).join(sources.groupBy("query").agg(F.count("*").alias("n")), "query", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    sent = asked.where("n > 0") if guards else asked
    replies = _asked(sent.select("query", "prompt"), factory, "prompt", "answer").select("query", strip(F.col("answer")).alias("answer"))
    valid = valid_answer(F.col("answer")) | (F.col("answer") == NOT_FOUND)
    replies = replies.withColumn("valid", valid).withColumn("answer", F.when(F.col("valid") | F.lit(not guards), F.col("answer")).otherwise(F.lit(NOT_FOUND)))
    shown = replies.join(spotlight_section(sources, spotlight), "query", "left") if spotlight else replies.withColumn("spotlight", F.lit(None).cast("string"))
    plain = has_spotlight(F.col("answer")) | (F.col("answer") == NOT_FOUND) | F.col("spotlight").isNull()
    shown = shown.select("query", F.when(plain, F.col("answer")).otherwise(F.concat("answer", F.lit("\n"), "spotlight")).alias("answer"), "valid")
    return questions.select("query").join(shown, "query", "left").select("query", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"), F.coalesce("valid", F.lit(True)).alias("valid"))


def evidence_answers(questions: DataFrame, evidence: DataFrame, factory: Factory, instructions: str = INSTRUCTIONS) -> DataFrame:
    """(query, answer, citations, n_evidence_chars): answers from rendered evidence (query, evidence), and the numbers they cite."""
    from tesserine.functions.text import citations

    rows = questions.join(evidence, "query").withColumn("prompt", F.concat(F.lit(f"{instructions}\n\nQuestion:\n"), "question", F.lit("\n\n"), "evidence"))
    replies = _asked(rows.select("query", "evidence", "prompt"), factory, "prompt", "answer")
    return replies.select("query", "answer", citations(F.col("answer")).alias("citations"), F.length("evidence").alias("n_evidence_chars"))
