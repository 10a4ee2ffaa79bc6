"""Chunk tables from JSON files, and the normalisation before they are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FIELDS = "id string, repo_id string, rel_path string, path string, start_line string, end_line string, language string, text string, summary_en string, chunk_hash string, retriever_score string"
_ITEM = f"struct<{_FIELDS.replace(' string', ':string')},_source:struct<{_FIELDS.replace(' string', ':string')}>>"
COLUMNS = ("id", "repo_id", "rel_path", "start_line", "end_line", "language", "text", "summary_en", "chunk_hash", "retriever_score")


def _typed(items: DataFrame) -> DataFrame:
    """The chunk columns of ``item``, unwrapped; a row whose line numbers aren't numbers is skipped."""
    field = lambda n: F.coalesce(F.col(f"item._source.{n}"), F.col(f"item.{n}"))
    number = lambda n: F.when(field(n).isNull(), F.lit(0)).otherwise(F.expr(f"try_cast(coalesce(item._source.{n}, item.{n}) AS INT)"))
    text = lambda n: F.coalesce(field(n), F.lit(""))
    rel = F.coalesce(field("rel_path"), field("path"), F.lit(""))
    out = items.select(
        text("id").alias("id"), text("repo_id").alias("repo_id"), rel.alias("rel_path"), number("start_line").alias("start_line"), number("end_line").alias("end_line"),
        text("language").alias("language"), field("text").alias("text"), field("summary_en").alias("summary_en"), field("chunk_hash").alias("chunk_hash"),
        F.expr("try_cast(coalesce(item._source.retriever_score, item.retriever_score) AS DOUBLE)").alias("retriever_score"),
    )
    return out.where("start_line IS NOT NULL AND end_line IS NOT NULL")


def read_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunks of JSONL files, read in splits. Lines that aren't JSON are skipped, or fail the job if ``strict``."""
    schema = f"{_FIELDS}, _source struct<{_FIELDS.replace(' string', ':string')}>, _bad string"
    rows = spark.read.schema(schema if not strict else schema.replace(", _bad string", "")).option("recursiveFileLookup", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    if not strict:
        rows = rows.where("_bad IS NULL").drop("_bad")
    return _typed(rows.select(F.struct("*").alias("item")))


def read_documents(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Chunks of JSON files: an array, or an object that wraps one in hits, chunks or results, in this order.

    An object without any of them gives no rows, or fails the job if ``strict``.
    """
    schema = f"{_FIELDS}, _source struct<{_FIELDS.replace(' string', ':string')}>, hits array<{_ITEM}>, chunks array<{_ITEM}>, results array<{_ITEM}>"
    rows = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)
    own = F.struct(*[F.col(f.split()[0]) for f in _FIELDS.split(", ")], F.col("_source"))
    wrapped = F.coalesce("hits", "chunks", "results")
    bare = F.coalesce(F.col("id"), F.col("_source.id"), F.col("text"), F.col("_source.text")).isNotNull()
    nothing = F.array().cast(f"array<{_ITEM}>")
    if strict:
        nothing = F.when(F.raise_error(F.lit("neither a list of chunks nor an object with hits")).isNull(), nothing)
    items = F.when(wrapped.isNotNull(), wrapped).when(bare, F.array(own)).otherwise(nothing)
    return _typed(rows.select(F.explode(items).alias("item")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query): the non-blank lines, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")


def read_relevant(spark: SparkSession, path: str) -> DataFrame:
    """(query, relevant_ids) of a CSV with the columns query and relevant_id."""
    rows = spark.read.option("header", True).csv(path).where("query IS NOT NULL AND relevant_id IS NOT NULL")
    return rows.groupBy(F.trim("query").alias("query")).agg(F.array_sort(F.collect_set(F.trim("relevant_id"))).alias("relevant_ids"))


def term_list(value: Column) -> Column:
    """A comma-separated string as a list without blanks."""
    return F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def normalized(chunks: DataFrame, symbol_columns: tuple[str, ...] = ("symbols", "def_symbols"), drop_blank: bool = False) -> DataFrame:
    """Symbol columns given as strings become lists; a primary_span that isn't two numbers becomes null; blank texts go if ``drop_blank``."""
    types = dict(chunks.dtypes)
    out = chunks.withColumns({c: term_list(F.col(c)) for c in symbol_columns if types.get(c) == "string"})
    if "primary_span" in types:
        span = F.col("primary_span")
        good = (F.size(span) == 2) & ~F.exists(span, lambda x: x.isNull())
        out = out.withColumn("primary_span", F.when(good, span))
    return out.where(F.length(F.trim("text")) > 0) if drop_blank else out


def with_ids(chunks: DataFrame) -> DataFrame:
    """A missing id becomes repository, path and number."""
    made = F.concat_ws("-", "repo_id", "rel_path", F.col("chunk_number").cast("string"))
    return chunks.withColumn("id", F.coalesce(F.nullif(F.col("id"), F.lit("")), made))


def newest(rows: DataFrame, key: str, *version: str) -> DataFrame:
    """One row per key: that with the greatest version, by a partial aggregate before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(*version)).alias("row")
    return rows.groupBy(key).agg(best).select(key, "row.*").select(*rows.columns)


def index_rows(chunks: DataFrame, most_chars: int = 30_000) -> DataFrame:
    """Rows ready to be embedded: the cut text, and 16 digits of the hashes of the whole and the cut text."""
    digest = lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 16)
    whole = F.coalesce("text", F.lit(""))
    return chunks.withColumns({"embedding_text": F.substring(whole, 1, most_chars), "text_hash": digest(whole)}).withColumn("embedding_hash", digest(F.col("embedding_text")))


def of_dimension(rows: DataFrame, dimension: int, embedding: str = "embedding") -> DataFrame:
    """The rows; the job fails at the first vector of another length."""
    size = F.coalesce(F.size(embedding), F.lit(-1))
    return rows.withColumn(embedding, F.when(size == dimension, F.col(embedding)).otherwise(F.raise_error(F.concat(F.lit(f"a vector should have {dimension} components, found "), size.cast("string")))))


def write_lines(chunks: DataFrame, path: str) -> None:
    """JSONL, one object a chunk."""
    chunks.write.mode("overwrite").json(path)


def file_order(chunks: DataFrame, file: str = "rel_path") -> DataFrame:
    """Chunk numbers from 1 and neighbour ids by start line within each file."""
    w = Window.partitionBy("repo_id", file).orderBy("start_line", "id")
    return chunks.withColumn("chunk_number", F.row_number().over(w)).withColumn("neighbors", F.struct(F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next")))
