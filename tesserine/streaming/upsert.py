"""Streaming upsert into a keyed table of plain Parquet files, with levelled compaction.

Each micro-batch is appended under its own number, already reduced to one row per key, and
reading takes the newest row of each key. A batch that is run again after a failure overwrites
its own folder, so every batch counts exactly once. Rows are put into buckets by key.

Compaction merges batches into a run of the first level, and as many runs of a level as the
fan-out into one of the next, bucket by bucket; a run holds each key once. What is in force is
a numbered manifest: the runs, and the greatest batch they hold. A new manifest is published
under the next number in one step once its runs are written, so a reader sees the table before
or after a compaction, and one that is interrupted leaves files that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StructType

from tesserine.sources import files
from tesserine.sources.chunks import newest


class UpsertLog:
    """A table of rows with a key and version columns, at a folder that all executors see."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str, *version: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.version, self.buckets = spark, path.rstrip("/"), schema, key, version, buckets
        self.stored = StructType([*schema.fields]).add("batch", LongType()).add("bucket", IntegerType())

    def _bucket(self, key: object):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def append(self, batch: DataFrame, number: int) -> None:
        """The newest row per key of the batch; the key must not be null. A batch that a run holds already isn't written again."""
        if number <= self.manifest()["covered"]:
            return
        rows = newest(batch.where(F.col(self.key).isNotNull()), self.key, *self.version)
        rows.select(*self.schema.names).withColumn("bucket", self._bucket(self.key)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={number}")

    def manifest(self) -> dict:
        """The manifest in force: its number, the greatest batch in runs, and the runs (path, level)."""
        numbers = [int(n[:-5]) for n in files.children(self.spark, f"{self.path}/_manifests") if n.endswith(".json")]
        if not numbers:
            return {"number": 0, "covered": -1, "runs": []}
        return files.read_json(self.spark, f"{self.path}/_manifests/{max(numbers)}.json")

    def _batches(self, after: int) -> list[int]:
        """Batches above a number that were written whole."""
        found = [int(n[6:]) for n in files.children(self.spark, self.path) if n.startswith("batch=")]
        return sorted(n for n in found if n > after and files.exists(self.spark, f"{self.path}/batch={n}/_SUCCESS"))

    def _open(self, runs: Sequence[str], batches: Sequence[int]) -> DataFrame:
        """The rows of runs and batches, with batch and bucket."""
        parts = [self.spark.read.schema(self.stored).parquet(f"{self.path}/_runs/{r}") for r in runs]
        if batches:
            parts.append(self.spark.read.schema(self.stored).option("basePath", self.path).parquet(*[f"{self.path}/batch={n}" for n in batches]))
        out = parts[0] if parts else self.spark.createDataFrame([], self.stored)
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def _merged(self, rows: DataFrame) -> DataFrame:
        """One row per key: the greatest version, of equal versions that of the latest batch. Rows meet by bucket, so a sorted write follows without another exchange."""
        rest = [c for c in rows.columns if c not in (self.key, "bucket")]
        best = F.max_by(F.struct(*rest), F.struct(*self.version, "batch")).alias("row")
        return rows.groupBy("bucket", self.key).agg(best).select(self.key, "row.*", "bucket").select(*rows.columns)

    def read(self, keys: Sequence[object] | None = None) -> DataFrame:
        """One row per key; with ``keys`` only those, read from their buckets alone. A table that is one run is read as it is."""
        manifest = self.manifest()
        batches = self._batches(manifest["covered"])
        runs = [r["path"] for r in manifest["runs"]]
        rows = self._open(runs, batches)
        if keys is not None:
            kind = self.schema[self.key].dataType
            wanted = [F.lit(k).cast(kind) for k in keys]
            rows = rows.where(F.col("bucket").isin(*[self._bucket(k) for k in wanted]) & F.col(self.key).isin(*wanted)) if wanted else rows.limit(0)
        if len(runs) + len(batches) > 1:
            rows = self._merged(rows)
        return rows.select(*self.schema.names)

    def compact(self, fanout: int = 4, whole: bool = False) -> bool:
        """Merge all batches so far into a run of level 1, then full levels upwards; ``whole``: everything into one run. False if there was nothing to do or another compaction was first."""
        manifest = self.manifest()
        batches, runs = self._batches(manifest["covered"]), list(manifest["runs"])
        level = max([r["level"] for r in runs], default=1)
        merging = runs if whole else []
        if not whole:
            level = 1
            while batches and len(same := [r for r in runs if r["level"] == level]) + 1 >= fanout:
                merging, level = merging + same, level + 1
        if not batches and len(merging) < 2:
            return False
        kept = [r for r in runs if r not in merging]
        name = uuid.uuid4().hex
        rows = self._merged(self._open([r["path"] for r in merging], batches).repartition(self.buckets, "bucket"))
        rows.sortWithinPartitions("bucket", self.key).write.partitionBy("bucket").parquet(f"{self.path}/_runs/{name}")
        number = manifest["number"] + 1
        return files.publish_json(self.spark, f"{self.path}/_manifests/{number}.json", {"number": number, "covered": max([manifest["covered"], *batches]), "runs": [*kept, {"path": name, "level": level}]})

    def vacuum(self) -> int:
        """Delete batches and runs that neither the manifest in force nor the one before it needs; their number. Not while a compaction runs."""
        numbers = sorted(int(n[:-5]) for n in files.children(self.spark, f"{self.path}/_manifests") if n.endswith(".json"))
        if not numbers:
            return 0
        held = [files.read_json(self.spark, f"{self.path}/_manifests/{n}.json") for n in numbers[-2:]]
        used = {r["path"] for m in held for r in m["runs"]}
        covered = held[0]["covered"] if len(held) > 1 else -1
        gone = [f"_runs/{r}" for r in files.children(self.spark, f"{self.path}/_runs") if r not in used]
        gone += [n for n in files.children(self.spark, self.path) if n.startswith("batch=") and int(n[6:]) <= covered]
        gone += [f"_manifests/{n}.json" for n in numbers[:-2]]
        for name in gone:
            files.delete(self.spark, f"{self.path}/{name}")
        return len(gone)

    def attach(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        """Start the upsert of a stream; ``trigger`` as in DataStreamWriter.trigger."""
        return stream.writeStream.foreachBatch(self.append).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def first_seen(stream: DataFrame, key: str, time: str, keep: str = "1 day") -> DataFrame:
    """The first row of each key within the time to live; state older than that is dropped."""
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


def read_json_stream(spark: SparkSession, path: str, schema: StructType, files: int = 1000) -> DataFrame:
    """New JSONL files of a folder, at most ``files`` a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(path)
