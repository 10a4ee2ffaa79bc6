"""BM25 over token arrays (Robertson and Zaragoza 2009; k1 1.2, b 0.75).

N, average length and document frequencies are those of the whole index, whatever a query
filters. Only postings of the query's terms leave the scan: everything else is dropped before
the explode, so the shuffle grows with the matches, not with the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions.text import tokens

K1, B = 1.2, 0.75


def length(text: Column) -> Column:
    """Number of tokens; null text has none."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9_]+"))


def field_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """(n, avgdl) of a text column."""
    return docs.agg(F.count("*").alias("n"), F.avg(length(F.col(text))).alias("avgdl"))


def scores(docs: DataFrame, terms: Sequence[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of documents that hold a term; scores rounded to 6 places."""
    body = F.lower(F.coalesce(F.col(text), F.lit("")))
    count = lambda t: F.regexp_count(body, F.lit(f"(?<![a-z0-9_]){re.escape(t)}(?![a-z0-9_])"))
    counts = F.array(*[F.struct(F.lit(t).alias("term"), count(t).alias("tf")) for t in dict.fromkeys(terms)])
    # lengths are counted after the rows of absent terms are gone, once per matching term
    postings = docs.select(doc_id, text, F.inline(counts)).where("tf > 0").select(doc_id, length(F.col(text)).alias("dl"), "term", "tf")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    stats = field_stats(docs, text)
    rows = postings.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # as many rows as query terms, and one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return rows.groupBy(doc_id).agg(F.round(F.sum(part), 6).alias("score"))


def best_fields(docs: DataFrame, fields: dict[str, float], terms: Sequence[str], doc_id: str = "doc_id") -> DataFrame:
    """The greatest of the boosted field scores; documents without a match are left out."""
    union = None
    for field, boost in fields.items():
        part = scores(docs, terms, doc_id, field).select(doc_id, (F.col("score") * boost).alias("score"))
        union = part if union is None else union.unionByName(part)
    return union.groupBy(doc_id).agg(F.max("score").alias("score"))


def has_phrase(text: Column, phrase: Sequence[str]) -> Column:
    """Whether the tokens of ``phrase`` stand next to each other."""
    return F.contains(F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" ")), F.lit(" " + " ".join(phrase) + " "))
