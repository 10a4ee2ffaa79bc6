"""A corpus pipeline: language ID, near-dedup, substring dedup, mixing, BPE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.llm import bpe, langid, mixing, neardup, shared, substrings

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: 38 bands of 5 registers: a pair at 0.8 shares none with probability 3e-7, as with op7's bands at 0.85.
NEAR = {"words": 5, "percent": 80, "bands": 38, "rows": 5}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null text or no letter. A missing label is filled in.

    Profiles are learned from the labelled documents outside the held-out fold. Without any
    label no language is known: then the documents with a letter stay as they are. Rows of
    repeated or null doc_id are judged each by its own text; an empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    profiles = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not profiles.languages:  # nothing to tell languages by
        return docs.where(F.col("text").rlike(r"\p{L}"))
    known = langid.predict(docs, profiles, keep_text=True).where(F.col("lang_pred") != langid.UNKNOWN)
    return known.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: five words, similarity 0.8 or more.

    It is the row with the least doc_id, nulls last, ties by a hash of the row. Rows are told
    apart by doc_id and that hash of all their columns, so ids may be null or repeat; of rows
    equal in every column one is kept. Rows without a word are no copies of each other, and
    all stay. An empty table gives no rows.
    """
    docs = docs.select(*COLUMNS)
    docs = docs.withColumn("row_key", F.xxhash64(*COLUMNS, *[F.isnull(c) for c in COLUMNS]))
    with shared.scratch(spark):
        rows = neardup.near_duplicates(docs, **NEAR, row_key=("row_key",)).where("n_shingles > 0")
        rows = rows.groupBy("doc_id", "row_key").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
        rows = shared.stage(rows.select(F.col("doc_id").alias("id"), F.col("row_key").alias("key"), "kept"), "decided", keep=True)
    small = lambda df: F.broadcast(df) if df.count() <= shared.BROADCAST_ROWS else df
    same = (F.col("row_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id"))
    out = docs.join(small(rows), same, "left_anti")
    repeated = rows.where("kept")
    if not repeated.isEmpty():
        out = out.unionByName(docs.join(small(repeated), same, "left_semi").dropDuplicates(["doc_id", "row_key"]))
    return out.select(*COLUMNS)


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that a document of a smaller doc_id holds; documents that lose every word go.

    A null doc_id counts as the smallest; rows of equal doc_id don't cut each other, and each is
    cut by its own text. Texts without a word stay. An empty table gives no rows.
    """
    cut = substrings.substring_dedup(docs.select(*COLUMNS)).where("n_removed = 0 OR n_removed < n_words")
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their target weights.

    A null source is a source of its own; documents of sources without a word go. Rows with
    equal doc_id and source are drawn alike, null doc_ids too. An empty table gives no rows.
    """
    return mixing.mix(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row; null text has none, repeated rows and ids are rows like others. An empty table gives no rows."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), with_ids=True)


STAGES = [("language_id", language), ("near_dedup", near_duplicates), ("substring_dedup", substring_duplicates), ("mixing", mixture), ("bpe", encode)]

#: BPE can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each but the last is written and read again."""
    docs = shared.read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.stage(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
