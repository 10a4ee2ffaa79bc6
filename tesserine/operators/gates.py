"""Gates before and after an answer: topics, intents, evidence and citations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.text import ascii_ratio, lines, meaningful, strip

#: A citation [repository|path:first-last]; a slash separates as well.
CITATION = r"\[[^|\]]+[|/][^:\]]+:\d+-\d+\]"


def contains_any(text: Column, terms: Sequence[str]) -> Column:
    """Whether any term is a substring, whatever the case. Null text holds none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(low, t)) if terms else F.lit(False)


def contains_each(text: Column, *groups: Sequence[str]) -> Column:
    """Whether every group has a term in the text: an intent made of a verb and a noun."""
    out = F.lit(True)
    for group in groups:
        out = out & contains_any(text, group)
    return out


def topic_terms(question: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """All terms of the first topic with a term in the question; an empty list if there is none."""
    out = None
    for terms in lexicon.values():
        hit, value = contains_any(question, terms), F.array(*[F.lit(t) for t in terms])
        out = F.when(hit, value) if out is None else out.when(hit, value)
    empty = F.array().cast("array<string>")
    return empty if out is None else out.otherwise(empty)


def relevance(hits: DataFrame, terms: Sequence[str], query: str = "query_id", text: str = "text", among: int = 8, least: int = 2) -> DataFrame:
    """(query, passes): enough of the first hits of each query hold a topic term. Without terms all pass."""
    hit = contains_any(F.col(text), terms) if terms else F.lit(True)
    needed = F.lit(least if terms else 0)
    return hits.where(F.col("rank") <= among).groupBy(query).agg((F.count_if(hit) >= needed).alias("passes"))


def evidence_overlap(hits: DataFrame, query: str = "query_id", question: str = "question", text: str = "text", among: int = 10, least: int = 2) -> DataFrame:
    """(query, n_found, passes): distinct meaningful words of the question that occur in its first hits; a question without any passes.

    Found words are gathered as sets of the question's own few words, so nothing grows with the hits' texts.
    """
    words = meaningful(F.col(question))
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    rows = hits.where(F.col("rank") <= among).select(query, F.size(words).alias("n_words"), F.filter(words, lambda w: F.contains(low, w)).alias("found"))
    grouped = rows.groupBy(query).agg(F.max("n_words").alias("n_words"), F.size(F.array_distinct(F.flatten(F.collect_set("found")))).alias("n_found"))
    return grouped.select(query, "n_found", ((F.col("n_found") >= least) | (F.col("n_words") <= 0)).alias("passes"))


def has_citation(text: Column) -> Column:
    return text.rlike(CITATION)


def cited_share(answer: Column) -> Column:
    """Share of an answer's lines that end with a citation; blank lines, fences and headings don't count. Null without such lines."""
    counted = F.filter(F.transform(lines(answer), strip), lambda x: (F.length(x) > 0) & ~F.startswith(x, F.lit("```")) & ~F.startswith(x, F.lit("#")))
    return F.try_divide(F.size(F.filter(counted, lambda x: x.rlike(CITATION + r"\s*$"))).cast("double"), F.size(counted))


def valid_answer(answer: Column, least: float = 0.8) -> Column:
    return F.coalesce(cited_share(answer) >= least, F.lit(False))


def english(text: Column, foreign: Sequence[str] = (), most: float = 0.3) -> Column:
    """At least 0.8 ASCII and at most ``most`` of the words foreign stopwords; empty text counts as English."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 0)
    share = F.coalesce(F.try_divide(F.size(F.filter(words, lambda w: w.isin(*foreign))), F.size(words)), F.lit(0.0)) if foreign else F.lit(0.0)
    return F.when(F.length(F.coalesce(text, F.lit(""))) == 0, F.lit(True)).otherwise((ascii_ratio(text) >= 0.8) & (share <= most))


def valid_summary(summary: Column, most: int = 160) -> Column:
    """Not empty, one line of at most ``most`` ASCII characters."""
    return F.coalesce((F.length(summary) > 0) & (F.length(summary) <= most) & ~summary.rlike(r"[\n\r]") & ~summary.rlike(r"[^\x00-\x7F]"), F.lit(False))


def unfounded(summary: Column, code: Column, synopsis: Column, terms: Sequence[str]) -> Column:
    """Whether the summary uses a listed term that is neither in the code nor in the synopsis."""
    s, c, y = (F.lower(F.coalesce(x, F.lit(""))) for x in (summary, code, synopsis))
    return F.exists(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(s, t) & ~F.contains(c, t) & ~F.contains(y, t))
