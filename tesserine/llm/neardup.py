"""MinHash near-dedup with SetSketch registers.

1. Each text becomes the set of its distinct n-word shingles (64-bit hashes) with one sketch.
   Equal sets (by size and a 128-bit digest) collapse into one class before anything else, so
   exact copies cost nothing more.
2. Bands of registers are the buckets. In each bucket every class is compared with the least
   class only (a star), never with all others.
3. A joint likelihood estimate from both sketches drops hopeless pairs; the rest are verified
   on their full shingle sets, recomputed from the texts.
4. Verified links give components. Buckets that still hold several are searched in blocks of
   bounded bytes, sketch against sketch across components and then full set against full set
   within the task, which gives no more links than connect the components. So a pair that
   shares a bucket stays unlinked only if the tests refuse it, and no task emits all pairs of a
   group. Only an exact test unites components, so no link is passed over for a wrong one.

With 32 bands of 6 registers a pair at similarity 0.85 shares no bucket with probability 3e-7.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserine.llm import shared
from tesserine.llm.components import roots
from tesserine.llm.sketches import enough_equal, may_reach, registers
from tesserine.llm.words import Words, grams, pieces

_NO_ID = -(1 << 63)


def shingle_sets(texts: pa.Array, words: int):
    """The sorted distinct shingle hashes of each text of an Arrow array."""
    for at, to in pieces(texts):
        batch = Words(texts.slice(at, to - at), lower=True)
        hashes = batch.hashes()
        all_grams = grams(hashes, words)
        for a, b in zip(batch.bounds[:-1], batch.bounds[1:], strict=True):
            n = b - a
            yield np.unique(all_grams[a : b - words + 1]) if n >= words else grams(hashes[a:b], n) if n else np.zeros(0, np.uint64)


def _digest(elements: np.ndarray) -> bytes:
    """Names a set: sets of equal name are taken as equal. 128 bits collide among 10^10 sets with a chance of 1e-19."""
    return xxhash.xxh3_128_digest(elements.tobytes())


def _sketched(words: int, m: int):
    def run(batches):
        for batch in batches:
            sizes, keys, regs = [], [], []
            for s in shingle_sets(batch.column("text"), words):
                sizes.append(len(s))
                keys.append(_digest(s) if len(s) else None)
                regs.append(registers(s, m).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(regs, pa.binary())], [*(c for c in batch.schema.names if c != "text"), "n_shingles", "set_key", "regs"])

    return shared.trimmed(run)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def _plausible(similarity: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = may_reach(_matrix(batch.column("regs_a")), _matrix(batch.column("regs_b")), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy(), similarity)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return shared.trimmed(run)


def _sets(words: int):
    def run(batches):
        for batch in batches:
            wanted, keys, sets = batch.column("set_key").to_pylist(), [], []
            for s, key in zip(shingle_sets(batch.column("text"), words), wanted, strict=True):
                if len(s) and _digest(s) == key:
                    keys.append(key)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "elements"])

    return shared.trimmed(run)


def _linked(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a").to_pylist(), batch.column("set_b").to_pylist(), strict=True):
                keep.append(_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return shared.trimmed(run)


def _similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _across(similarity: float, percent: int, rows: int):
    """Links of different components between two blocks of a bucket, no more than connect them.

    A pair is looked at in the first band that it shares only. Links are tested on the full
    sets, and components are united after that test alone.
    """

    def run(table: pa.Table) -> pa.Table:
        regs, elements = _matrix(table.column("regs").combine_chunks()), table.column("elements").to_pylist()
        cids = table.column("cid").to_pylist()
        code = {c: i for i, c in enumerate(sorted({*cids, *table.column("comp").to_pylist()}))}
        cid, comp = (np.array([code[x] for x in table.column(c).to_pylist()]) for c in ("cid", "comp"))
        sizes, side, band = (table.column(c).to_numpy() for c in ("n", "side", "band"))
        least, band = enough_equal(regs.shape[1], similarity), int(band[0])
        earlier = regs[:, : band * rows]
        others = np.flatnonzero(side != 0)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.get(x, x)) != x:
                x = up
            return x

        left, right = [], []

        def tested(pairs: list[np.ndarray]) -> None:
            x, y = np.concatenate(pairs).T
            ok = may_reach(regs[x], regs[y], sizes[x], sizes[y], similarity)
            for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                one, two = find(int(comp[i])), find(int(comp[j]))
                if one != two and _similar(np.frombuffer(elements[i], np.uint64), np.frombuffer(elements[j], np.uint64), percent):
                    root[max(one, two)] = min(one, two)
                    left.append(cids[i])
                    right.append(cids[j])

        waiting, n = [], 0
        for i in np.flatnonzero(side != 1):
            other = others[(comp[others] != comp[i]) & ((cid[others] > cid[i]) | (side[i] == 0))]
            other = other[(regs[other] == regs[i]).sum(axis=1) >= least]
            if band and len(other):
                other = other[~(earlier[other] == earlier[i]).reshape(len(other), band, rows).all(axis=2).any(axis=1)]
            waiting.append(np.column_stack([np.full(len(other), i), other]))
            n += len(other)
            if n > 20_000:
                tested(waiting)
                waiting, n = [], 0
        if n:
            tested(waiting)
        shared.release()
        return pa.table({"a": pa.array(left, pa.binary()), "b": pa.array(right, pa.binary())})

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, bands: int = 32, rows: int = 6, block_bytes: int = 4 << 20, row_key: Sequence[str] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    docs: doc_id, text, and any other columns. Texts with a Jaccard similarity of at least
    ``percent`` / 100 are linked; component_id is the least doc_id reachable, kept says whether
    it is the document's own. Fewer than ``words`` words: the whole sequence is one shingle.
    Null or wordless text: no shingle, no link, component_id is its own doc_id. Null doc_id:
    the row links as others do, and lends its component no id; repeated doc_ids stay rows of
    their own, each linked by its own text. An empty table gives no rows.

    ``row_key`` names columns that tell rows of one doc_id apart. They are returned as well, and
    kept is then true for one (doc_id, key) of each component: the least doc_id, nulls last,
    then the least key.
    """
    similarity, m = percent / 100, bands * rows
    keyed = shared.pick(docs, "doc_id", "text", *row_key)
    docs = keyed.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), F.xxhash64("text").alias("text_hash"), "text")
    shared.bounded_batches(docs.sparkSession)
    carried = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keyed.schema.fields if f.name != "text")
    with shared.scratch(docs.sparkSession):
        staged = shared.stage(keyed.withColumn("text_hash", F.xxhash64("text")).mapInArrow(_sketched(words, m), f"{carried}text_hash long, n_shingles long, set_key binary, regs binary"), "sketches", keep=True)
        place = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", *row_key)
        holder = F.min(F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("key"), "text_hash"))  # a row whose text gives the class its set
        classes = staged.where("set_key IS NOT NULL").groupBy(F.col("set_key").alias("cid"))
        classes = classes.agg(F.min("doc_id").alias("label"), F.count("*").alias("copies"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"), holder.alias("holder"), F.min(place).alias("first"))
        classes = shared.stage(classes, "classes")
        banded = classes.select("cid", F.posexplode(F.expr(f"transform(sequence(0, {bands - 1}), i -> xxhash64(i, substring(regs, i * {2 * rows} + 1, {2 * rows})))")).alias("band", "bucket"))
        shared_buckets = shared.stage(banded.groupBy("bucket").agg(F.min("cid").alias("star"), F.count("*").alias("members")).where("members > 1"), "buckets")
        members = shared.stage(banded.join(shared_buckets, "bucket"), "members")

        sketch = lambda side: classes.select(F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("regs").alias(f"regs_{side}"))
        stars = members.where("cid <> star").select(F.col("cid").alias("a"), F.col("star").alias("b")).distinct()
        plausible = stars.join(sketch("a"), "a").join(sketch("b"), "b").mapInArrow(_plausible(similarity), "a binary, b binary")
        links = _verified(docs, classes, shared.stage(plausible, "pairs"), words, percent)
        comps = shared.stage(roots(links), "comps")

        rest = _open(members, classes, comps, block_bytes)
        if not rest.isEmpty():
            rest = rest.join(_full_sets(docs, classes, rest.select("cid").distinct(), words), F.col("cid") == F.col("set_key"))
            paired = rest.select("*", F.explode(F.expr("sequence(0, blocks - 1)")).alias("j")).select(
                "bucket", "band", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), F.expr("CASE WHEN i = j THEN 2 WHEN i < j THEN 0 ELSE 1 END").alias("side"), "cid", "comp", "n", "regs", "elements"
            )
            across = shared.stage(paired.groupBy("bucket", "lo", "hi").applyInArrow(_across(similarity, percent, rows), "a binary, b binary").distinct(), "across")
            if not across.isEmpty():
                comps = shared.stage(roots(links.union(across)), "comps")

        in_comp = classes.join(comps, classes.cid == comps.node, "left").select("cid", "label", "copies", "first", F.coalesce("root", "cid").alias("root"))
        least = in_comp.groupBy("root").agg(F.min("label").alias("component"), F.min("first").alias("first"))
        found = shared.stage(in_comp.select("cid", "copies", "root").join(least, "root").drop("root"), "found", keep=True)
    return _placed(staged.drop("regs", "text_hash"), found).select(
        "doc_id",
        *row_key,
        "n_shingles",
        F.expr("CASE WHEN set_key IS NULL THEN doc_id ELSE component END").alias("component_id"),
        (F.isnull("set_key") | (place.eqNullSafe(F.col("first")) if row_key else F.expr("doc_id <=> component"))).alias("kept"),
    )


def _placed(rows: DataFrame, found: DataFrame, many: int = 100_000) -> DataFrame:
    """Every row with the component and first row of its class.

    Rows without a set take part in no join. Classes of more than ``many`` copies are few, rows
    / many at most, and are joined by a broadcast, as one may hold a third of all rows.
    """
    large = found.where(F.col("copies") > many).drop("copies")
    small = found.where(F.col("copies") <= many).drop("copies")
    bare = rows.where("set_key IS NULL")
    for field in found.drop("cid", "copies").schema.fields:
        bare = bare.withColumn(field.name, F.lit(None).cast(field.dataType))
    sets = rows.where("set_key IS NOT NULL")
    if large.isEmpty():
        return sets.join(small, sets.set_key == small.cid).drop("cid").unionByName(bare)
    hot = sets.join(F.broadcast(large), sets.set_key == large.cid).drop("cid")
    rest = sets.join(F.broadcast(large.select("cid")), sets.set_key == F.col("cid"), "left_anti")
    return rest.join(small, rest.set_key == small.cid).drop("cid").unionByName(hot).unionByName(bare)


def _open(members: DataFrame, classes: DataFrame, comps: DataFrame, block_bytes: int) -> DataFrame:
    """Members of the buckets that hold several components, with sketches, dealt to blocks i of their bucket by the bytes of its sets."""
    in_comp = members.join(comps, members.cid == comps.node, "left").select("bucket", "band", "cid", F.coalesce("root", "cid").alias("comp"))
    several = in_comp.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("bucket")
    rest = in_comp.join(several, "bucket").join(classes.select("cid", "n", "regs"), "cid")
    size = rest.groupBy("bucket").agg(F.ceil(F.sum(8 * F.col("n") + F.octet_length("regs")) / block_bytes).alias("blocks"))
    return shared.stage(rest.join(size, "bucket").withColumn("i", F.expr("pmod(xxhash64(cid), blocks)")), "open")


def _full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(set_key, elements) of the wanted classes, recomputed from the text of one row of each."""
    wanted = shared.stage(wanted.join(classes.select("cid", "holder"), "cid").select(F.col("cid").alias("set_key"), "holder.*"), "wanted")
    few = wanted.count() <= shared.BROADCAST_ROWS
    texts = docs.join(F.broadcast(wanted) if few else wanted, ["key", "text_hash"]).select("set_key", "text").dropDuplicates(["set_key"])
    return shared.stage(texts.mapInArrow(_sets(words), "set_key binary, elements binary"), "sets")


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose full shingle sets are similar enough."""
    sets = _full_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), words)
    side = lambda s: sets.select(F.col("set_key").alias(s), F.col("elements").alias(f"set_{s}"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_linked(percent), "a binary, b binary")
    return shared.stage(checked, "links")
