"""Summaries and keywords of chunks by an injected model, with caches, checks, retries and fallbacks.

Every chunk leaves by one lane: kept (it has a summary), generated (a template), cached, model,
or fallback (rules). Nothing is asked twice, and what the model gave is returned for the cache.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.functions import keywords as K
from tesserine.functions.text import is_generated, sha_key, strip
from tesserine.operators import models
from tesserine.operators.gates import valid_summary

ASK = "Summarise the code in one English sentence of up to 160 characters and give six to eight keywords of two to four words. Reply with JSON: {\"summary_en\": \"\", \"keywords_en\": []}."
TIGHTEN = "The reply broke the rules. One ASCII sentence of up to 160 characters, only what the code shows."
_ANSWER = "summary string, keywords array<string>"
#: Prompts of one call of a model.
WINDOW = 256


def prompt(kind: Column, symbol: Column, synopsis: Column, text: Column, most: int = 6000) -> Column:
    """What the model is asked about a chunk: its declaration, its file and up to ``most`` characters of code."""
    part = lambda label, c: F.when(F.length(c) > 0, F.concat(F.lit(label), c)).otherwise(F.lit(""))
    return F.concat(F.lit(ASK), part("\nDeclaration: ", F.concat_ws(" ", kind, symbol)), part("\nFile: ", synopsis), F.lit("\n```\n"), F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit("\n```"))


def synopsis_prompt(path: Column, language: Column, text: Column, most: int = 4000) -> Column:
    """What the model is asked about a file: its path, language and first ``most`` characters."""
    return F.concat(F.lit("Describe the file in two sentences.\nPath: "), path, F.lit("\nLanguage: "), F.coalesce(language, F.lit("")), F.lit("\n```\n"), F.substring(F.coalesce(text, F.lit("")), 1, most), F.lit("\n```"))


def parsed(reply: str | None) -> tuple[str, list[str]] | None:
    """(summary, keywords) of a JSON reply, fenced or not; None if it isn't one."""
    body = (reply or "").strip()
    begin, end = body.find("{"), body.rfind("}")
    try:
        found = json.loads(body[begin : end + 1]) if 0 <= begin < end else None
        return str(found["summary_en"]), [str(k) for k in found.get("keywords_en") or []]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def _asked(rows: DataFrame, factory: models.Factory) -> DataFrame:
    """The rows with summary and keywords: a reply that isn't valid is asked for once more, with a reminder. Only prompts leave the JVM, and a model is asked WINDOW of them at a time."""

    def good(answer: tuple[str, list[str]] | None) -> bool:
        return answer is not None and 0 < len(answer[0].strip()) <= 160 and answer[0].isascii() and "\n" not in answer[0]

    def replies(model: Callable[[list[str]], list], prompts: list[str]) -> list[tuple[str | None, list[str]]]:
        found = [parsed(r) for r in model(prompts)]
        again = [i for i, a in enumerate(found) if not good(a)]
        for i, reply in zip(again, model([f"{prompts[i]}\n{TIGHTEN}" for i in again]) if again else [], strict=True):
            found[i] = parsed(reply) or found[i]
        return [a or (None, []) for a in found]

    @F.pandas_udf(_ANSWER)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = None
        for prompts in batches:
            model = model or factory()
            got = [a for at in range(0, len(prompts), WINDOW) for a in replies(model, list(prompts.iloc[at : at + WINDOW]))]
            yield pd.DataFrame({"summary": pd.Series([a[0] for a in got], dtype=object), "keywords": pd.Series([a[1] for a in got], dtype=object)})

    return rows.withColumn("answer", run.asNondeterministic()("prompt")).withColumns({c: F.col(f"answer.{c}") for c in ("summary", "keywords")}).drop("answer")


def enriched(chunks: DataFrame, cache: DataFrame, factory: models.Factory, version: str = "v1", overwrite: bool = False, dry_run: bool = False) -> DataFrame:
    """The chunks with summary_en, keywords_en, lane and cache_key.

    chunks: id, rel_path, text, node_kind, primary_symbol, receiver, symbols (array), synopsis,
    summary_en, keywords_en. cache: cache_key, value (struct summary, keywords). The summary is
    normalised and the keywords reduced to noun phrases; a summary that is invalid even then is
    written by rules. A dry run asks no model: its lane is ``pending``.
    """
    key = F.concat_ws(":", F.lit(version), sha_key(F.col("text")), sha_key(F.col("synopsis"), 8))
    rows = chunks.withColumn("cache_key", key).join(cache.select("cache_key", F.col("value").alias("held")).dropDuplicates(["cache_key"]), "cache_key", "left")
    has = F.lit(not overwrite) & (F.length(strip(F.coalesce("summary_en", F.lit("")))) > 0)
    lane = F.when(has, "kept").when(F.coalesce(is_generated(F.col("rel_path"), F.col("text")), F.lit(False)), "generated").when(F.col("held").isNotNull() & F.lit(not overwrite), "cached").otherwise("model")
    rows = rows.withColumn("lane", lane)
    template = K.generated_summary(F.col("rel_path"))
    known = rows.where("lane <> 'model'").withColumn("summary", F.when(F.col("lane") == "generated", template["summary"]).when(F.col("lane") == "cached", F.col("held.summary"))).withColumn("keywords", F.when(F.col("lane") == "generated", template["keywords"]).when(F.col("lane") == "cached", F.col("held.keywords")))
    left = rows.where("lane = 'model'")
    if dry_run:
        new = left.withColumn("summary", F.lit(None).cast("string")).withColumn("keywords", F.lit(None).cast("array<string>")).withColumn("lane", F.lit("pending"))
    else:
        asked = _asked(left.withColumn("prompt", prompt(F.col("node_kind"), F.col("primary_symbol"), F.col("synopsis"), F.col("text"))), factory).drop("prompt")
        tidy = K.normalized_summary(K.english_summary(F.col("summary")))
        fallback = K.fallback_summary(F.col("node_kind"), F.col("primary_symbol"), F.col("receiver"), F.col("symbols"))
        new = asked.withColumn("lane", F.when(valid_summary(tidy), "model").otherwise("fallback")).withColumn("summary", F.when(valid_summary(tidy), tidy).otherwise(fallback)).withColumn("keywords", K.linted_nouns(K.english_keywords("keywords")))
    out = known.unionByName(new)
    given = F.col("lane").isin("kept", "pending")
    return out.withColumn("summary_en", F.when(given, F.col("summary_en")).otherwise(F.col("summary"))).withColumn("keywords_en", F.when(given, F.col("keywords_en")).otherwise(F.col("keywords"))).select(*chunks.columns, "lane", "cache_key")


def to_cache(rows: DataFrame, now: Column, lifetime: str | None = None) -> DataFrame:
    """(cache_key, value, created_at, expires_at): the entries to write back, of the rows that a model or rules answered. Without a lifetime (an interval such as ``1 DAY``) they last for ever."""
    expires = F.lit(None).cast("timestamp") if lifetime is None else now + F.expr(f"INTERVAL {lifetime}")
    new = rows.where(F.col("lane").isin("model", "fallback")).dropDuplicates(["cache_key"])
    return new.select("cache_key", F.struct(F.col("summary_en").alias("summary"), F.col("keywords_en").alias("keywords")).alias("value"), now.alias("created_at"), expires.alias("expires_at"))


def lanes(rows: DataFrame) -> DataFrame:
    """(lane, n)."""
    return rows.groupBy("lane").agg(F.count("*").alias("n"))


def merged_cache(cache: DataFrame, entries: DataFrame) -> DataFrame:
    """The newest entry of each key."""
    newest = lambda df: df.select("cache_key", F.struct("created_at", "value", "expires_at").alias("e"))
    return newest(cache).unionByName(newest(entries)).groupBy("cache_key").agg(F.max_by("e", F.col("e.created_at")).alias("e")).select("cache_key", "e.value", "e.created_at", "e.expires_at")
