"""Sharding by sampled splitters: size-weighted key samples, quantile boundaries, range partitions.

The key is a hash of the text, so equal texts share a range. A bounded sample of keys, drawn
with a chance proportional to size, gives the boundaries of fine ranges. Exact sizes of the
ranges show which are overfull: those are subdivided by key, and single keys that are
overfull by themselves by doc_id and, among rows equal in both, by ordinal. The resulting cells, in key order, are dealt to the shards
by exact cumulative size. Equal texts of up to 1 / (64 * shards) of all bytes are dealt as one,
so they share a shard however many rows they are; only heavier ones may part. DataFrame functions only; the driver gets sums and boundaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm import shared

RANGES_LOG2 = 8
#: Expected number of sampled keys.
SAMPLE = 16384
#: Equal rows made from one count at once.
COPIES = 4096


def _unit(*columns: Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of boundaries at or below the key, by binary search over 2**RANGES_LOG2 - 1 of them."""
    array = F.array(*[F.lit(b).cast("long") for b in bounds])
    found = F.lit(0)
    for step in reversed(range(RANGES_LOG2)):
        found = (lambda lo, width: F.get(F.transform(F.array(lo), lambda x: x + F.when(F.get(array, x + (width - 1)) <= key, F.lit(width)).otherwise(F.lit(0))), F.lit(0)))(found, 1 << step)
    return found


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with an ordinal from 0 among equal rows: they are counted, and dealt anew from their count in bounded parts."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}"))))
    chunks = chunks.repartition("key", "doc_id", "chunk")
    last = F.least(F.col("copies"), (F.col("chunk") + 1) * COPIES) - 1
    return chunks.withColumn("ordinal", F.explode(F.sequence(F.col("chunk") * COPIES, last))).drop("copies", "chunk")


def shard(docs: DataFrame, shards: int = 8, row_limit: int = 100_000, seed: int = 11) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    The law is ``bytes``: shards hold nearly equal sums of size, the text's UTF-8 bytes plus 1.
    Equal texts share a shard, unless together they hold more than 1 / (64 * shards) of all
    bytes: those are dealt by doc_id, and rows of equal doc_id by ordinal. ``row_limit`` bounds the rows that one task numbers, and
    moves no row. Null text has no bytes and CRC 0, and counts as equal to empty text. slot
    numbers a shard's rows from 0 without gaps, ties by doc_id, null first. Null and repeated
    doc_ids are rows like others. Other columns are left out. An empty table gives no rows.
    """
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(docs["doc_id"], (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.shiftright(F.xxhash64(text), 11).alias("key"))
    rows = shared.stage(rows, "rows")
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    limit = max(1, total // (shards * 64))

    chance = F.col("size") * F.lit(SAMPLE / max(1, total))
    sample = rows.where(_unit(F.lit(seed), "doc_id", "key") < chance).select("key", F.greatest(F.lit(1), F.round(chance)).cast("long").alias("weight"))
    steps = [i / (1 << RANGES_LOG2) for i in range(1, 1 << RANGES_LOG2)]
    bounds = sample.agg(F.percentile("key", F.array(*[F.lit(x) for x in steps]), F.col("weight")).alias("b")).first()[0]
    bounds = [int(b) for b in bounds] if bounds else [0] * len(steps)
    ranged = rows.withColumn("range", _range_of(F.col("key"), bounds))

    by_key = shared.stage(ranged.groupBy("range", "key").agg(F.sum("size").alias("b"), F.count("*").alias("r")), "keys")
    parts = lambda b, r: F.ceil(F.greatest(b / F.lit(limit), r / F.lit(row_limit)))
    heavy = by_key.where((F.col("b") > limit) | (F.col("r") > row_limit)).select("range", "key", parts(F.col("b"), F.col("r")).alias("key_parts"), (F.col("b") > limit).alias("parted"))
    heavy = shared.stage(heavy, "heavy")
    light = by_key.join(heavy.select("key", F.lit(1).alias("is_heavy")), "key", "left").where("is_heavy IS NULL").groupBy("range").agg(parts(F.sum("b"), F.sum("r")).alias("range_parts"))
    small = lambda df: F.broadcast(df) if df.count() <= shared.BROADCAST_ROWS // 4 else df
    cells = ranged.join(small(heavy.drop("range")), "key", "left").join(F.broadcast(light), "range", "left")  # light: 2**RANGES_LOG2 rows at most
    cells = _numbered(cells.where("key_parts IS NOT NULL")).unionByName(cells.where("key_parts IS NULL").withColumn("ordinal", F.lit(0).cast("long")))
    cells = cells.withColumn("heavy_key", F.when(F.col("key_parts").isNotNull(), F.col("key"))).withColumn(
        "part", F.when(F.col("key_parts").isNotNull(), F.pmod(F.xxhash64("doc_id", "ordinal", F.lit(seed)), "key_parts")).otherwise(F.pmod(F.xxhash64("key", F.lit(seed)), "range_parts"))
    )
    together = F.col("key_parts").isNotNull() & ~F.col("parted")
    cells = cells.select("doc_id", "size", "text_crc32", "key", "range", F.coalesce("heavy_key", F.lit(-(1 << 63))).alias("heavy_key"), "part", F.when(together, F.lit(-1)).otherwise(F.col("part")).alias("unit"))

    cell = ["range", "heavy_key", "part"]
    sums = cells.groupBy(*cell, "unit").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    so_far = Window.orderBy("range", "heavy_key", "unit")  # cells of one unit are peers and get the same sum
    unit = Window.partitionBy("range", "heavy_key", "unit")
    middle = F.sum("b").over(so_far.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("b").over(unit) / 2
    dealt = sums.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(max(1, total)))).cast("int"))
    in_shard = Window.partitionBy("shard").orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    dealt = shared.stage(dealt.withColumn("first_slot", F.coalesce(F.sum("r").over(in_shard), F.lit(0))).select(*cell, "shard", "first_slot"), "dealt")
    placed = cells.withColumn("at", F.row_number().over(Window.partitionBy(*cell).orderBy("key", "doc_id", "size")) - 1).join(small(dealt), cell)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first_slot") + F.col("at")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
