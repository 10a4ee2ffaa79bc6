"""Order MinHash fingerprints (Marcais, DeBlasio, Pandey, Kingsford 2019), DataFrame functions only.

The units of a text are its words, cut into parts of at most 12 characters; a k-mer is k
consecutive units, and the i-th occurrence of a k-mer counts as an element of its own. Elements
fall into ``slots`` bins by hash; in each bin the ``least`` smallest by hash are selected, put
back into text order, and their k-mers hashed as a tuple. Two texts that agree in a bin share
those k-mers in that order, so the share of equal bins falls with the edit distance and not
only with the set of words.

All steps are array expressions within one row: k-mer hashes packed with their positions are
sorted as longs, runs of equal hashes give the occurrence numbers, and a second sort by bin and
hash gives the minima. Nothing is exploded or shuffled for a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserine.llm import shared

UNIT = r"[^\x20\x09-\x0D]{1,12}"
#: Bits for a position; hashes fill the rest.
_AT = 28
_NO_ID = -(1 << 63)


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = 3, slots: int = 64, least: int = 2, pool: str = "__fp") -> DataFrame:
    """``df`` with the sorted integer array ``out`` of bin and tuple hash of the column ``text``; no k-mers give an empty array."""
    u, p, s, q, t = (f"{pool}_{x}" for x in "upsqt")
    mask = (1 << _AT) - 1
    bits = slots.bit_length() - 1
    assert 1 << bits == slots, "slots must be a power of two"
    names = df.columns
    neighbours = ", ".join(["h"] + [f"get({u}, i + {j})" for j in range(1, k)])
    df = df.withColumn(u, F.expr(f"transform(regexp_extract_all({text}, '({UNIT.replace(chr(92), chr(92) * 2)})', 1), w -> xxhash64(w))"))
    df = df.select(*names, F.expr(f"transform({u}, (h, i) -> shiftleft(xxhash64({neighbours}), {_AT}) | i)").alias(p))
    df = df.select(*names, p, F.sort_array(p).alias(s))
    begins = f"filter(sequence(0, size({s}) - 1), i -> i = 0 OR shiftright(get({s}, i), {_AT}) <> shiftright(get({s}, i - 1), {_AT}))"
    df = df.select(*names, p, s, F.expr(f"CASE WHEN size({s}) > 0 THEN {begins} ELSE array() END").alias(t))
    element = f"shiftleft(xxhash64(shiftright(get({s}, j), {_AT}), j - b), {_AT}) | (get({s}, j) & {mask}L)"
    runs = f"flatten(transform({t}, (b, r) -> transform(sequence(b, coalesce(get({t}, r + 1), size({s})) - 1), j -> coalesce({element}, 0L))))"
    df = df.select(*names, p, F.expr(runs).alias(q))
    df = df.select(*names, p, F.sort_array(q).alias(q))
    bin_of = lambda x: f"shiftrightunsigned({x}, {64 - bits})"
    df = df.select(*names, p, F.expr(f"filter({q}, (x, i) -> i < {least} OR {bin_of('x')} <> {bin_of(f'get({q}, i - {least})')})").alias(t))
    df = df.select(*names, p, t, F.expr(f"CASE WHEN size({t}) > 0 THEN filter(sequence(0, size({t}) - 1), i -> i = 0 OR {bin_of(f'get({t}, i)')} <> {bin_of(f'get({t}, i - 1)')}) ELSE array() END").alias(s))
    chosen = f"array_sort(transform(slice({t}, b + 1, coalesce(get({s}, r + 1), size({t})) - b), x -> x & {mask}L))"
    tuple_hash = f"xxhash64(transform({chosen}, a -> shiftright(get({p}, int(a)), {_AT})))"
    return df.select(*names, F.expr(f"transform({s}, (b, r) -> int(shiftleft({bin_of(f'get({t}, b)')}, {32 - bits}) - 2147483648L | ({tuple_hash} & {(1 << (32 - bits)) - 1}L)))").alias(out))


def likeness(a: Column, b: Column, slots: int = 64) -> Column:
    """Share of equal bins among those that either fingerprint fills; 1 for two empty ones."""
    bins = lambda x: F.transform(x, lambda v: F.shiftright(v, 32 - slots.bit_length() + 1))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def as_text(a: Column) -> Column:
    """Eight hex digits for each filled bin: the bin first, then the hash."""
    return F.array_join(F.transform(a, lambda v: F.lower(F.lpad(F.hex(v.cast("long") + F.lit(1 << 31)), 8, "0"))), "")


def successors(keys: DataFrame, width_log2: int = 12) -> DataFrame:
    """(key, next) of distinct long keys; the last one's next is null.

    Keys are cut into buckets of 2**width_log2 values; the next key is looked for within the
    bucket, and for a bucket's last key in the next bucket that has any, found the same way.
    No task gets more than 2**width_log2 keys.
    """
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    if low is None or high - low < 1 << width_log2:
        return keys.select("key", F.lead("key").over(Window.orderBy("key")).alias("next"))
    bucketed = keys.withColumn("bucket", F.shiftright("key", width_log2))
    inside = bucketed.withColumn("next", F.lead("key").over(Window.partitionBy("bucket").orderBy("key")))
    firsts = shared.stage(bucketed.groupBy("bucket").agg(F.min("key").alias("first")), "firsts")
    after = successors(firsts.select(F.col("bucket").alias("key")), width_log2).join(firsts.select(F.col("bucket").alias("next"), "first"), "next").select(F.col("key").alias("bucket"), "first")
    return inside.join(after, "bucket", "left").select("key", F.coalesce("next", "first").alias("next"))


def fingerprints(docs: DataFrame, k: int = 3, slots: int = 64, least: int = 2) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has its last floor(n_chars / 2) characters replaced by the first as many
    of the next document's, in ascending doc_id, the first one's after the last. Returns
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null text is empty. A null doc_id sorts first. Rows that share a doc_id all have the
    document of the next doc_id as their next; where that id has several rows, the start that
    sorts first and the shortest text's fingerprint. A single document is its own next. An empty table gives no rows.
    """
    docs = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)).alias("key"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    sizes = shared.stage(docs.select("key", F.length("text").cast("int").alias("n")).groupBy("key").agg(F.max("n").alias("n")), "sizes")
    ordered = successors(sizes.select("key"))
    first = sizes.agg(F.min("key")).first()[0]
    ordered = ordered.select("key", F.coalesce("next", F.lit(first)).alias("next"))
    asked = shared.stage(ordered.join(sizes, "key").select(F.col("next").alias("key"), F.col("key").alias("asker"), F.floor(F.col("n") / 2).cast("int").alias("half")), "asked")
    heads = docs.join(asked, "key").select(F.col("asker").alias("key"), F.expr("left(text, half)").alias("head"), F.col("key").alias("next"))
    heads = heads.groupBy("key").agg(F.min(F.struct("head", "next")).alias("h")).select("key", "h.*")
    edited = docs.join(heads, "key").withColumn("n_chars", F.length("text").cast("long")).withColumn("half", F.floor(F.col("n_chars") / 2).cast("int"))
    edited = edited.select("key", "next", "n_chars", "text", F.expr("concat(left(text, int(n_chars) - half), left(head, half))").alias("edited"))
    marked = with_fingerprint(edited, "text", "fp", k, slots, least).drop("text")
    marked = with_fingerprint(marked.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)), "edited", "efp", k, slots, least).drop("edited")
    marked = shared.stage(marked, "marked")
    others = marked.groupBy("key").agg(F.min(F.struct("n_chars", "fp")).alias("o")).select(F.col("key").alias("next"), F.col("o.fp").alias("next_fp"))
    return marked.join(others, "next").select(
        F.nullif("key", F.lit(_NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("efp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp"), slots).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp"), slots).alias("near_next")
    )
