"""Query plans: what a question asks for, by rules, and how a model's plan is laid over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.names import guessed_language
from tesserine.functions.text import strip

FILE = r"[\w./-]+\.(?:py|js|ts|tsx|go|rb|php|java|scala|rs|cpp|c)\b"
IDENTIFIER = r"\b[A-Za-z_][A-Za-z0-9_]*\b"
#: Boosts of the clauses on a planned symbol, path and language.
BOOSTS = {"primary_symbol": 8, "symbols": 6, "rel_path": 3, "language": 2}
SHOULD = "array<struct<field:string,term:string,boost:int>>"
LISTS = ("identifiers", "keywords", "file_hints", "negative_hints", "bm25_should", "bm25_must", "router_terms")
TEXTS = ("clarified_query", "language", "hyde_passage")


def _found(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def _clause(field: str, term: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), term.alias("term"), F.lit(BOOSTS[field]).alias("boost"))


def heuristic_plan(questions: DataFrame, question: str = "question") -> DataFrame:
    """The questions with the columns of a plan; names come in the order of the question.

    identifiers (10 names of three characters or more), file_hints (8), language, keywords,
    negative_hints, bm25_should (up to 12 weighted clauses), bm25_must, router_terms and a
    passage to embed. A null question plans as the empty one.
    """
    text = F.coalesce(F.col(question), F.lit(""))
    none = F.array().cast("array<string>")
    names = F.filter(_found(text, IDENTIFIER), lambda x: F.length(x) >= 3)
    files, language = _found(text, FILE), guessed_language(text)
    terms = F.slice(F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= 4), 1, 6)
    by_language = F.when(language != "", F.array(_clause("language", language))).otherwise(F.array().cast(SHOULD))
    by_name = F.flatten(F.transform(F.slice(names, 1, 6), lambda s: F.array(_clause("primary_symbol", s), _clause("symbols", s))))
    should = F.slice(F.concat(by_name, F.transform(F.slice(files, 1, 4), lambda f: _clause("rel_path", f)), by_language), 1, 12)
    about = F.when(F.size(names) > 0, F.slice(names, 1, 4)).otherwise(terms)
    passage = F.concat(F.lit("Code that defines or uses "), F.array_join(about, ", "), F.lit(", with its files and lines, in answer to: "), strip(text))
    return questions.withColumns({
        "clarified_query": strip(text), "language": language, "identifiers": F.slice(names, 1, 10), "keywords": F.filter(terms, lambda w: ~F.array_contains(names, w)), "file_hints": F.slice(files, 1, 8),
        "negative_hints": F.when(F.contains(F.lower(text), F.lit("test")), none).otherwise(F.array(F.lit("*test*"))), "bm25_should": should,
        "bm25_must": F.when(language != "", F.array(_clause("language", language))).otherwise(F.array().cast(SHOULD)),
        "router_terms": F.when(F.size(names) > 0, F.slice(names, 1, 3)).otherwise(terms), "hyde_passage": passage,
    })


def merged(primary: Column, fallback: Column, is_list: bool) -> Column:
    """The primary value of a plan's field where it isn't empty, else the fallback's."""
    given = F.size(primary) > 0 if is_list else F.length(strip(primary)) > 0
    return F.when(F.coalesce(given, F.lit(False)), primary).otherwise(fallback)


def merge_plans(plans: DataFrame, primary: str = "model") -> DataFrame:
    """Plans whose struct column ``primary`` (a model's plan, null where there is none) overrides them field by field."""
    held = {f.name for f in plans.schema[primary].dataType.fields}
    fields = {name: merged(F.col(f"{primary}.{name}"), F.col(name), name in LISTS) for name in (*TEXTS, *LISTS) if name in held}
    return plans.withColumns(fields).drop(primary)


def plan_prompt(question: Column, overviews: Column) -> Column:
    """What a planning model is asked: the question and the first 800 characters of up to two repository overviews (array of repo_id, overview)."""
    known = F.array_join(F.transform(F.slice(overviews, 1, 2), lambda g: F.concat(F.lit("- "), g["repo_id"], F.lit(": "), F.substring(F.coalesce(g["overview"], F.lit("")), 1, 800))), "\n")
    asked = F.lit("Plan a code search. Reply with one JSON object of the keys " + ", ".join((*TEXTS, *LISTS)) + ".\n\nQuestion: ")
    return F.concat(asked, question, F.lit("\n\nRepositories:\n"), known)
