"""Embedding into a stored table that can be interrupted and taken up again."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StringType, StructType

from tesserine.operators import models
from tesserine.sources import files


class EmbeddingSink:
    """A folder of embedded rows, written window by window.

    A window is a share of the rows by a hash of their key, one Spark job of many tasks. Its
    vectors, and the rows that no cap helped (dead letters), are written by the same job, so a
    text is embedded once; the window counts when that job has committed. A run that is killed
    leaves a window without a commit, which nobody reads; the next run takes up the rows that no
    committed window holds with the text they have now.
    """

    def __init__(self, spark: SparkSession, path: str, rows: StructType, key: str = "id", text: str = "text") -> None:
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text
        self.schema = StructType([rows[key]]).add("text_sha", StringType()).add("embedding", ArrayType(FloatType())).add("cap", IntegerType()).add("error", StringType())

    def _committed(self) -> list[str]:
        found = []
        for run in files.children(self.spark, self.path):
            if run.startswith("run="):
                found += [f"{self.path}/{run}/{w}" for w in files.children(self.spark, f"{self.path}/{run}") if files.exists(self.spark, f"{self.path}/{run}/{w}/_SUCCESS")]
        return found

    def written(self) -> DataFrame:
        """All rows of committed windows: the schema with run, window and kind (vector or dead)."""
        full = StructType([*self.schema.fields]).add("run", IntegerType()).add("window", IntegerType()).add("kind", StringType())
        paths = self._committed()
        if not paths:
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).option("basePath", self.path).parquet(*paths)

    def vectors(self) -> DataFrame:
        """The newest vector of each key."""
        rows = self.written().where("kind = 'vector'")
        best = F.max_by(F.struct("text_sha", "embedding", "cap"), "run").alias("r")
        return rows.groupBy(self.key).agg(best).select(self.key, "r.*")

    def dead_letters(self) -> DataFrame:
        """Rows without a vector for their text, with the last error."""
        rows = self.written()
        had = rows.where("kind = 'vector'").select(self.key, "text_sha")
        return rows.where("kind = 'dead'").groupBy(self.key, "text_sha").agg(F.max_by("error", "run").alias("error"), F.max("run").alias("run")).join(had, [self.key, "text_sha"], "left_anti")

    def progress(self) -> DataFrame:
        """(run, window, vectors, dead) of each committed window that held rows."""
        return self.written().groupBy("run", "window").agg(F.count_if(F.col("kind") == "vector").alias("vectors"), F.count_if(F.col("kind") == "dead").alias("dead"))

    def pending(self, rows: DataFrame, again: bool = False) -> DataFrame:
        """Rows whose key and text no committed window holds; with ``again`` dead letters count as not held."""
        held = self.written()
        held = held.where("kind = 'vector'") if again else held
        hashed = rows.where(F.col(self.key).isNotNull()).dropDuplicates([self.key]).withColumn("text_sha", F.sha2(F.coalesce(F.col(self.text), F.lit("")).cast("binary"), 256))
        return hashed.join(held.select(self.key, "text_sha"), [self.key, "text_sha"], "left_anti")

    def run(self, rows: DataFrame, factory: models.Factory, windows: int = 16, again: bool = False, caps: Sequence[int] = (30_000, 8_000, 4_000, 2_000), attempts: int = 3, wait: float = 1.0, sleep=time.sleep) -> int:
        """Embed what is pending; the number of windows that held rows. A window's job that fails is tried again after wait, 2 wait, ...; then the error is raised, and what was committed stays.

        Null keys are left out; of rows that share a key one is taken.
        """
        numbers = [int(n[4:]) for n in files.children(self.spark, self.path) if n.startswith("run=")]
        number = max(numbers, default=0) + 1
        todo, shape = f"{self.path}/_todo/run={number}", StructType([rows.schema[self.key], rows.schema[self.text]]).add("text_sha", StringType())
        slot = F.pmod(F.xxhash64(self.key), F.lit(windows)).cast("int")
        self.pending(rows, again).select(*shape.names, slot.alias("window")).write.mode("overwrite").partitionBy("window").parquet(todo)
        held = set(files.children(self.spark, todo))
        for window in (w for w in range(windows) if f"window={w}" in held):
            part = models.embed(self.spark.read.schema(shape).parquet(f"{todo}/window={window}"), factory, self.text, caps).drop(self.text)
            part = part.withColumn("kind", F.when(F.col("embedding").isNull(), "dead").otherwise("vector")).select(*self.schema.names, "kind")
            for attempt in range(attempts):
                try:
                    part.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/run={number}/window={window}")
                    break
                except Exception:
                    if attempt + 1 == attempts:
                        raise
                    sleep(wait * 2**attempt)
        files.delete(self.spark, todo)
        return sum(w.startswith("window=") for w in held)
