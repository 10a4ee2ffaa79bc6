"""Mixing sources to target weights: floor(rate) copies of each document and one more by chance.

Token counts are summed per source, the targets follow from the weights, and a source's rate is
target / size. A document is emitted floor(rate) times, plus once more where a number drawn
from a hash of seed and doc_id lies below the fraction of the rate. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm import shared

#: Sources up to which their rates are broadcast.
FEW_SOURCES = 10_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of MD5 of "seed:doc_id"."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of ``sizes(source, size)``.

    Sources by code point, null last, get the weights in turn and share ``share`` times all
    sizes. A target is at most ``most`` times its source's size; what that leaves over is
    shared again by weight until no target is above. That end is found in one pass: sources
    sorted by cap / weight, where each prefix that is capped leaves a level for the rest.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = per_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1).withColumn("weight", w)
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    rest = every.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    levels = capped.withColumn("level", (F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    level = F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), True).over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.withColumn("final", level).select("source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight"))).alias("target"))


def with_copies(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 7, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, size, source_size, target, copies, and ``carry``) of every document.

    docs: doc_id, text, source. Null text has size 0, a null source is a source of its own,
    a null doc_id draws as the text "null", and rows with equal doc_id and source draw alike.
    A source of size 0 is taken 0 times. An empty table gives no rows. One row per source goes
    through a single task; documents meet their rate by a join that is salted against sources
    with very many rows.
    """
    salt = 32
    sized = docs.select(docs["doc_id"], docs["source"], *[docs[c] for c in carry], word_count(docs["text"]).alias("size"))
    if not carry:
        sized = shared.stage(sized.select("doc_id", "source", "size"), "sizes")
    rates = shared.stage(targets(sized.select("source", "size"), weights, share, most), "rates")
    small = rates.count() <= FEW_SOURCES
    keyed = rates.withColumn("__known", F.coalesce("source", F.lit(""))).withColumn("__null", F.col("source").isNull()).drop("source")
    docs_keyed = sized.withColumn("__known", F.coalesce("source", F.lit(""))).withColumn("__null", F.col("source").isNull())
    if small:
        joined = docs_keyed.join(F.broadcast(keyed), ["__known", "__null"])
    else:
        keyed = keyed.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salt - 1).cast("long"))))
        joined = docs_keyed.withColumn("__salt", F.pmod(F.xxhash64("doc_id"), F.lit(salt))).join(keyed, ["__known", "__null", "__salt"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + (draw(F.col("doc_id"), seed) < rate - F.floor(rate)).cast("long")
    return joined.select("doc_id", "source", *carry, "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    packed = docs.select(docs["doc_id"], docs["source"], docs["text"], F.struct(*[docs[c] for c in docs.columns]).alias("__row"))
    taken = with_copies(packed, carry=["__row"], **options)
    return taken.where("copies > 0").withColumn("__copy", F.explode(F.expr("sequence(1L, copies)"))).select("__row.*")
