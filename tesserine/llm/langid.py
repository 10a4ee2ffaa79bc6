"""Language ID by rank-order n-gram profiles (Cavnar and Trenkle 1994).

A profile is the ranking of the most frequent letter n-grams (n from 1 to 3, words padded with
a blank, lower case). A document gets the language whose profile has the least out-of-place
distance to the document's own ranking; an n-gram that a profile lacks costs ``top``.
Profiles count every n-gram of every training text; no text is cut or sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm import shared

#: More label values than this are refused: profiles are kept on the driver.
MAX_LANGUAGES = 2000
UNKNOWN = "und"
_LETTER: np.ndarray | None = None


@dataclass(frozen=True)
class Profiles:
    """languages[j] has rank ranks[j, i] (0 is the most frequent) for the n-gram grams[i]; ``top`` where it lacks it."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray
    top: int


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def gram_codes(text: str) -> np.ndarray:
    """Codes of all n-grams of the text, 21 bits a character; empty without letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    letter = _letters()[points]
    points = np.where(letter, points, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    s = np.concatenate(([32], points[keep], [32]))
    if len(s) > 2 and s[-2] == 32:
        s = s[:-1]
    if len(s) < 3:
        return np.zeros(0, np.int64)
    blank = s == 32
    pairs = (s[:-1] << 21) | s[1:]
    triples = ((pairs[:-1] << 21) | s[2:])[~blank[1:-1]]
    return np.concatenate((s[~blank], pairs, triples))


def _counted(batches):
    for batch in batches:
        pending: dict[str, list[np.ndarray]] = {}
        waiting = 0
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            codes = gram_codes(text)
            pending.setdefault(lang, []).append(codes)
            waiting += len(codes)
            if waiting > 4_000_000:
                yield from _flushed(pending)
                pending, waiting = {}, 0
        yield from _flushed(pending)


def _flushed(pending):
    for lang, codes in pending.items():
        grams, counts = np.unique(np.concatenate(codes), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])


def fit(labelled: DataFrame, top: int = 400) -> Profiles:
    """Profiles of all languages in ``labelled`` (text, lang); null text or lang is left out.

    Ties in frequency go to the smaller code. The driver gets ``top`` rows a language.
    """
    shared.bounded_batches(labelled.sparkSession)
    rows = labelled.select(labelled["text"], labelled["lang"]).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.mapInArrow(shared.trimmed(_counted), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("rank") <= top)
    found = ranked.select("lang", "gram", (F.col("rank") - 1).alias("rank")).limit(MAX_LANGUAGES * top + 1).toPandas()
    languages = sorted(found["lang"].unique())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: is lang the label column?")
    grams = np.unique(found["gram"].to_numpy(np.int64)) if len(found) else np.zeros(0, np.int64)
    ranks = np.full((len(languages), len(grams)), top, np.int32)
    if len(found):
        ranks[np.searchsorted(languages, found["lang"]), np.searchsorted(grams, found["gram"].to_numpy(np.int64))] = found["rank"]
    return Profiles(tuple(languages), grams, ranks, top)


def classify(text: str | None, profiles: Profiles) -> tuple[str, float]:
    """Language and score: 1 is a distance of 0, 0 the greatest distance."""
    codes = gram_codes(text) if text else ()
    if not len(codes) or not profiles.languages:
        return UNKNOWN, 0.0
    grams, counts = np.unique(codes, return_counts=True)
    grams = grams[np.argsort(-counts, kind="stable")[: profiles.top]]
    at = np.minimum(np.searchsorted(profiles.grams, grams), len(profiles.grams) - 1)
    known = profiles.grams[at] == grams
    own = np.arange(len(grams), dtype=np.int32)
    away = np.abs(profiles.ranks[:, at[known]] - own[known])
    away = np.where(profiles.ranks[:, at[known]] == profiles.top, profiles.top, away)
    distance = away.sum(axis=1) + profiles.top * int((~known).sum())
    best = int(np.argmin(distance))
    return profiles.languages[best], float(1 - distance[best] / (profiles.top * len(grams)))


def predict(docs: DataFrame, profiles: Profiles, keep_text: bool = False) -> DataFrame:
    """``docs`` without text (unless kept) and with lang_pred and score; only the column text is looked at.

    Null text or text without a letter: ``und`` with score 0. Equal distances go to the
    language that sorts first. Columns named lang_pred or score are replaced.
    """
    shared.bounded_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    fields = [f for f in docs.schema.fields if keep_text or f.name != "text"]

    def run(batches):
        for batch in batches:
            found = [classify(t, profiles) for t in batch.column("text").to_pylist()]
            rest = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], rest + ["lang_pred", "score"])

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.mapInArrow(shared.trimmed(run), f"{rest}{', ' if rest else ''}lang_pred string, score double")


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """Whether crc32 of the id as text is divisible by ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
