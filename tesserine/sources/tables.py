"""Life cycle of stored tables: create, drop, sample, statistics, and caches by configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of an indexed chunk; the dimension of its vectors is checked when they are written.
CHUNK = "id string, repo_id string, rel_path string, language string, chunk_number int, start_line int, end_line int, primary_symbol string, symbols array<string>, text string, summary_en string, keywords_en array<string>, text_sha string, indexed_at timestamp, embedding array<float>"
CACHE = "cache_key string, value string, created_at timestamp, expires_at timestamp"


def create_table(spark: SparkSession, name: str, schema: str | StructType = CHUNK, force: bool = False, partition_by: str | None = None) -> bool:
    """Create an empty table; False if it is there. ``force`` drops it first."""
    if force:
        drop_table(spark, name)
    if spark.catalog.tableExists(name):
        return False
    writer = spark.createDataFrame([], schema).write.format("parquet")
    (writer.partitionBy(partition_by) if partition_by else writer).saveAsTable(name)
    return True


def drop_table(spark: SparkSession, name: str) -> bool:
    """Drop a table; False if there is none."""
    there = spark.catalog.tableExists(name)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    return there


def append(rows: DataFrame, name: str, dimensions: int | None = None, vector: str = "embedding") -> None:
    """Append rows by the table's columns; a vector of other than ``dimensions`` fails the write."""
    if dimensions is not None:
        message = F.concat(F.lit(f"{vector} must have {dimensions} dimensions, not "), F.size(vector).cast("string"))
        rows = rows.withColumn(vector, F.when(F.col(vector).isNull() | (F.size(vector) == dimensions), F.col(vector)).otherwise(F.raise_error(message)))
    spark = rows.sparkSession
    fields = spark.table(name).schema.fields
    rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]).write.mode("append").insertInto(name)


def sample_one(rows: DataFrame, *columns: str) -> dict | None:
    """Some row's columns; None of an empty table."""
    row = rows.select(*columns or ["*"]).limit(1).first()
    return row.asDict(recursive=True) if row else None


def statistics(rows: DataFrame) -> DataFrame:
    """One row: the number of rows, and of rows without a value for each column."""
    return rows.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in rows.columns])


def cache_table(spark: SparkSession, name: str | None) -> DataFrame:
    """The cache of a name, created if need be; no name is a cache that holds nothing."""
    if name is None:
        return spark.createDataFrame([], CACHE)
    create_table(spark, name, CACHE)
    return spark.table(name)
