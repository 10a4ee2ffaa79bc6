"""An inverted index as a table, and scored queries composed over it.

A posting is (field, term, key, tf, dl, positions). Postings are stored by bucket of the term
and sorted by term, so a query reads the row groups of its own terms, not the texts. N, the
average length and document frequencies are those of the whole index, whatever a query filters.

Clauses are built of ``match``, ``phrase``, ``best_fields`` and ``constant``; ``search`` adds
up those that must and those that should match.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Folders that terms are dealt to, unless told otherwise.
BUCKETS = 64
#: Tokens that one task is meant to sort and write, the bytes of a text that count as a token, and the bytes of texts whose postings are made together.
POSTINGS, TOKEN, BLOCK = 2_000_000, 6, 16 << 20
#: Whether a byte belongs to a token.
_WORD = np.isin(np.arange(256), np.frombuffer(b"abcdefghijklmnopqrstuvwxyz0123456789_", np.uint8))


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_of(term: str, buckets: int) -> int:
    """The same number on the driver: Spark's hash is XXH64 with seed 42, signed."""
    found = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return (found - (1 << 64) if found >> 63 else found) % buckets


def _places(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of lower-case texts, in order: their terms, their rows, their places in the row; and the number of tokens of each row."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    ends = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    size = int(ends[-1] - ends[0])
    data = np.frombuffer(texts.buffers()[2], np.uint8, size, ends[0]) if size else np.zeros(0, np.uint8)
    ends -= ends[0]
    held = _WORD[data]
    border = np.zeros(size + 1, bool)  # a token doesn't go on in the next row
    border[ends] = True
    starts = held.copy()
    starts[1:] &= ~held[:-1] | border[1:-1]
    lasts = held.copy()
    lasts[:-1] &= ~held[1:] | border[1:-1]
    starts, lasts = np.flatnonzero(starts), np.flatnonzero(lasts)
    until = np.append(0, np.cumsum(lasts - starts + 1)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(until), pa.py_buffer(data[held])).dictionary_encode()
    first = np.searchsorted(starts, ends)
    n = np.diff(first)
    return words, np.repeat(np.arange(len(n)), n), np.arange(len(starts)) - np.repeat(first[:-1], n), n


def _by_code(codes: np.ndarray) -> np.ndarray:
    """A stable order of non-negative codes; sixteen bits at a time, which numpy sorts in linear time."""
    order = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    return order if len(codes) == 0 or codes.max() < 1 << 16 else order[np.argsort((codes[order] >> 16).astype(np.uint16), kind="stable")]


def _block(field: str, keys: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """One row a distinct term of the texts, with its postings in the order of the rows."""
    words, row, place, n = _places(texts)
    codes = words.indices.to_numpy()
    order = _by_code(codes)
    row, codes = row[order], codes[order]
    new = np.append(True, codes[1:] != codes[:-1])[: len(codes)]
    head = np.flatnonzero(new | np.append(True, row[1:] != row[:-1])[: len(codes)])
    until = np.append(head, len(codes)).astype(np.int32)
    places = pa.ListArray.from_arrays(pa.array(until), pa.array(place[order].astype(np.int32)))
    of = row[head]
    rows = pa.StructArray.from_arrays([keys.take(pa.array(of)), pa.array(n[of].astype(np.int32)), pa.array(np.diff(until)), places], ["key", "dl", "tf", "positions"])
    term = np.flatnonzero(new[head])
    blocks = pa.ListArray.from_arrays(pa.array(np.append(term, len(head)).astype(np.int32)), rows)
    names = words.dictionary.take(pa.array(codes[head[term]]))
    return pa.RecordBatch.from_arrays([pa.array([field] * len(names), pa.string()), names, blocks], ["field", "term", "rows"])


def _blocks(names: Sequence[str], most: int):
    """Rows of key and lower-case texts, ``most`` bytes of texts at a time and a whole text at least, as blocks of postings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(i + 1) for i in range(len(names))]
            size = np.cumsum(sum(pc.binary_length(t).to_numpy(zero_copy_only=False).astype(np.int64) for t in texts))
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
                for name, text in zip(names, texts, strict=True):
                    yield _block(name, batch.column(0).slice(at, to - at), text.slice(at, to - at))
                at = to

    return run


@contextmanager
def _as_they_come(spark: SparkSession, folders: int) -> Iterator[None]:
    """Writes of up to so many folders a task don't sort their rows by folder again."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, folders)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def build(docs: DataFrame, key: str, fields: Mapping[str, Column], path: str, buckets: int = BUCKETS) -> None:
    """Write the index of the fields (text columns; null counts as empty) below ``path``.

    The tokens of BLOCK bytes of rows are counted and placed together, so what is shuffled, once,
    is one row a distinct term of a block, with its postings. A bucket is dealt to as many tasks as
    its share of POSTINGS asks for, by a block's first key: no task holds all rows of a frequent
    term. Lengths are added up from the postings, so texts are cut once.
    """
    spark = docs.sparkSession
    n = docs.count()
    texts = [F.coalesce(text, F.lit("")) for text in fields.values()]
    size = docs.agg(F.sum(sum((F.octet_length(t).cast("long") for t in texts), F.lit(0).cast("long")))).first()[0] or 0
    salts = 1 + size // (buckets * POSTINGS * TOKEN)
    kind = docs.schema[key].dataType.simpleString()
    lower = docs.select(F.col(key).alias("key"), *[F.lower(t).alias(f"f{i}") for i, t in enumerate(texts)])
    blocks = lower.mapInArrow(_blocks(list(fields), BLOCK), f"field string, term string, rows array<struct<key: {kind}, dl: int, tf: int, positions: array<int>>>").withColumn("bucket", _bucket(F.col("term"), buckets))
    part = F.col("bucket") * salts + F.pmod(F.xxhash64(F.col("rows")[0]["key"]), F.lit(salts)).cast("int")
    dealt = blocks.repartitionById(buckets * salts, part).sortWithinPartitions("bucket", "field", "term", F.col("rows")[0]["key"])
    with _as_they_come(spark, buckets):
        dealt.select("field", "term", "bucket", F.inline("rows")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    frequent = spark.read.parquet(f"{path}/postings").groupBy("bucket", "field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("tokens"))
    frequent.repartition("bucket").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    total = dict(spark.read.parquet(f"{path}/terms").groupBy("field").agg(F.sum("tokens")).collect())  # one row a field
    stats = [(name, n, total.get(name, 0) / n, buckets) for name in fields] if n else []
    spark.createDataFrame(stats, "field string, n long, avgdl double, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/fields")


class Index:
    """A stored index. Scores are (key, score), one row for each key that matches."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path
        fields = spark.read.parquet(f"{path}/fields").collect()  # one row a field
        self.stats = {r.field: (r.n, r.avgdl) for r in fields}
        self.buckets = fields[0].buckets if fields else BUCKETS
        self.postings = spark.read.parquet(f"{path}/postings")

    def _rows(self, table: str, field: str, terms: Sequence[str]) -> DataFrame:
        numbers = sorted({bucket_of(t, self.buckets) for t in terms})
        rows = self.postings if table == "postings" else self.spark.read.parquet(f"{self.path}/{table}")
        return rows.where(F.col("bucket").isin(numbers) & (F.col("field") == field) & F.col("term").isin(*terms))

    def _idf(self, field: str, terms: Sequence[str]) -> dict[str, float]:
        """The weight of each term that occurs: one row a term of the query."""
        n = self.stats.get(field, (0, 0.0))[0]
        weight = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        return {r.term: r.idf for r in self._rows("terms", field, terms).select("term", weight.alias("idf")).collect()}

    def _part(self, field: str, idf: Column, tf: Column) -> Column:
        return idf * tf / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(self.stats[field][1] or 1.0)))

    def _none(self) -> DataFrame:
        return self.postings.limit(0).select("key", F.lit(0.0).alias("score"))

    def match(self, field: str, text: str | Sequence[str], boost: float = 1.0) -> DataFrame:
        """Sum over the terms of ``text`` that a field holds."""
        terms = list(dict.fromkeys(_terms(text)))
        idf = self._idf(field, terms) if terms else {}
        if not idf:
            return self._none()
        weight = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])[F.col("term")]
        rows = self._rows("postings", field, list(idf)).select("key", (self._part(field, weight, F.col("tf")) * boost).alias("part"))
        return rows.groupBy("key").agg(F.sum("part").alias("score"))

    def phrase(self, field: str, text: str | Sequence[str], boost: float = 1.0) -> DataFrame:
        """Fields that hold the terms of ``text`` next to each other, scored as one term whose weight is the sum of theirs."""
        terms = _terms(text)
        idf = self._idf(field, list(dict.fromkeys(terms))) if terms else {}
        if not terms or len(idf) < len(set(terms)):
            return self._none()
        rows = self._rows("postings", field, list(idf)).groupBy("key").agg(F.first("dl").alias("dl"), F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("m")).where(F.size("m") == len(idf))
        starts = F.col("m")[terms[0]]
        for i, term in enumerate(terms[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.col("m")[term], _less(i)))
        found = rows.select("key", "dl", F.size(starts).alias("tf")).where("tf > 0")
        return found.select("key", (self._part(field, F.lit(sum(idf[t] for t in terms)), F.col("tf")) * boost).alias("score"))

    def best_fields(self, fields: Mapping[str, float], text: str | Sequence[str]) -> DataFrame:
        """The greatest of the boosted scores of the fields."""
        return _max([self.match(f, text, boost) for f, boost in fields.items()])

    def any_phrase(self, fields: Sequence[str], texts: Sequence[str]) -> DataFrame:
        """Keys that hold one of the phrases in one of the fields; the scores of those that they hold add up."""
        return _sum([self.phrase(f, t) for t in texts for f in fields])


def _terms(text: str | Sequence[str]) -> list[str]:
    import re

    return [t for t in re.split(r"[^a-z0-9_]+", text.lower()) if t] if isinstance(text, str) else [t.lower() for t in text]


def _less(places: int):
    return lambda at: at - places


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _sum(parts: Sequence[DataFrame]) -> DataFrame:
    return _union(parts).groupBy("key").agg(F.sum("score").alias("score"))


def _max(parts: Sequence[DataFrame]) -> DataFrame:
    return _union(parts).groupBy("key").agg(F.max("score").alias("score"))


def constant(docs: DataFrame, key: str, scores: Sequence[tuple[Column, float]]) -> DataFrame:
    """Clauses of a constant score: the sum of those whose condition holds for a row."""
    total = sum((F.when(condition, F.lit(score)).otherwise(F.lit(0.0)) for condition, score in scores), F.lit(0.0))
    return docs.select(F.col(key).alias("key"), total.alias("score")).where("score > 0")


def search(must: Sequence[DataFrame] = (), should: Sequence[DataFrame] = (), keys: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(key, score): the sum of all clauses, of keys that every ``must`` clause holds.

    keys: the rows that a filter leaves (key). With such a filter and no ``must`` clause, rows
    without a match stay at score 0; without a filter some clause has to match.
    """
    clauses = [c.withColumn("must", F.lit(1)) for c in must] + [c.withColumn("must", F.lit(0)) for c in should]
    scored = _union(clauses).groupBy("key").agg(F.sum("score").alias("score"), F.sum("must").alias("must")).where(F.col("must") >= len(must)).select("key", "score")
    if keys is not None:
        scored = keys.select("key").join(scored, "key", "left" if not must else "inner")
    return scored.select("key", F.round(F.coalesce("score", F.lit(0.0)), digits).alias("score"))


#: Boosts of the fields that queries of each generation look in.
FIELDS = {
    "v2": {"text": 3, "symbols": 4, "module": 1, "rel_path": 1},
    "v3": {"primary_symbol": 8, "def_symbols": 6, "symbols": 4, "rel_path": 3, "doc_head": 2, "text": 1},
    "v3_json": {"text": 3, "primary_symbol": 6, "def_symbols": 5, "symbols": 4, "doc_head": 3, "rel_path": 2, "primary_kind": 2},
    "router_v1": {"short_title": 3, "summary": 2, "domains": 2, "key_modules": 1, "key_symbols": 1, "tech_stack": 1},
    "router_v2": {"short_title": 4, "summary": 3, "key_symbols": 5, "keywords": 4, "synonyms": 3, "tech_stack": 2, "modules": 2, "important_files": 1.5, "sample_queries": 2},
    "exact": {"symbols": 6, "text": 2, "path": 1},
    "hybrid": {"text": 2, "path": 1},
}
#: Path fragments that raise a chunk's score, much and a little.
PROMOTED = ("adapters/", "clients/", "service/")
OTHERS = ("cmd/", "serve/", "server/", "grpc", ".pb.go", ".proto", "main.go", "bootstrap", "init")


def fielded(index: Index, generation: str, text: str, keys: DataFrame | None = None) -> DataFrame:
    """The best-fields query of a generation; a router query (without keys) leaves rows without a match out."""
    return search(should=[index.best_fields(FIELDS[generation], text)], keys=keys)


def guarded(index: Index, text: str, topic: Sequence[str], keys: DataFrame, fields: Mapping[str, float] | None = None, held_in: Sequence[str] = ("text", "symbols")) -> DataFrame:
    """Rows that hold a topic term as a phrase, scored by it and by the best field."""
    return search(must=[index.any_phrase(held_in, topic)], should=[index.best_fields(fields or FIELDS["v3"], text)], keys=keys)


def by_intent(index: Index, text: str, groups: Sequence[Sequence[str]], docs: DataFrame, key: str, path: Column, fields: Mapping[str, float] | None = None, held_in: Sequence[str] = ("text", "symbols", "rel_path"), promoted: Sequence[str] = PROMOTED, others: Sequence[str] = OTHERS) -> DataFrame:
    """Rows with a word of every group, scored by the groups, the best field and constants for path fragments: 3 for promoted ones (a project's own folders are added by the caller), 0.3 for the others."""
    must = [index.best_fields(dict.fromkeys(held_in, 1.0), list(words)) for words in groups]
    paths = constant(docs, key, [(F.contains(path, F.lit(p)), 3.0) for p in promoted] + [(F.contains(path, F.lit(p)), 0.3) for p in others])
    return search(must=must, should=[index.best_fields(fields or FIELDS["v3"], text), paths], keys=docs.select(F.col(key).alias("key")))


def exact(index: Index, text: str, keys: DataFrame | None = None, knn: DataFrame | None = None, fields: Mapping[str, float] | None = None, phrase_field: str = "text") -> DataFrame:
    """The phrase at six times its score and the best field; with ``knn`` (key, score) its scores add to them."""
    return search(should=[index.phrase(phrase_field, text, 6.0), index.best_fields(fields or FIELDS["exact"], text), *([knn] if knn is not None else [])], keys=keys)


def filters(docs: DataFrame, key: str, project: Column | None = None, ext: Column | None = None, path: Column | None = None) -> DataFrame:
    """(key) of the rows that pass all conditions given."""
    for condition in (project, ext, path):
        if condition is not None:
            docs = docs.where(condition)
    return docs.select(F.col(key).alias("key"))


def planned(index: Index, docs: DataFrame, key: str, clauses: Sequence[tuple[str, str, float]], text: str, language: str = "", fields: tuple[str, str] = ("summary_en", "text"), size: int = 300) -> DataFrame:
    """Candidates of a plan: up to 12 weighted clauses (a symbol as a phrase), the question in the summary at 2 and in the text at 1; rows of the language only, those without a match at 0."""
    parts = [index.phrase(f, t, b) if f == "primary_symbol" else index.match(f, t, b) for f, t, b in clauses[:12]]
    parts += [index.match(fields[0], text, 2.0), index.match(fields[1], text, 1.0)]
    kept = docs.where(F.col("language") == language) if language else docs
    return search(should=parts, keys=kept.select(F.col(key).alias("key"))).orderBy(F.desc("score"), "key").limit(size)
