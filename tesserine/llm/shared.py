"""Tables and files that every executor can see, and the memory of Python workers.

Intermediate results are written below ``spark.checkpoint.dir`` and read again, so a lost
executor costs only the tasks that ran there. Where the session has none, a folder is set here
for a local master only; a cluster must name its shared folder.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes up to which a table may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 32 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tesserine-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Paths of the tables staged inside each open scratch block.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are emptied at the end, so that a later step doesn't find the disk full of them.

    Those staged with ``keep`` are left to the enclosing block, or for good: the caller's plan
    reads them. Emptying is an overwrite by no rows, which any file system of Spark's allows.
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            spark.range(0, numPartitions=1).write.mode("overwrite").parquet(path)


def stage(df: DataFrame, name: str, keep: bool = False, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tesserine/{name}-{uuid.uuid4().hex}"
    writer = df.write.options(**options) if options else df.write
    writer.parquet(path)
    if len(_SCRATCH) > keep:
        _SCRATCH[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Let no batch sent to a Python worker hold many more than ``size`` bytes, so that a worker's memory doesn't depend on the length of texts.

    Plans read the limit when they run, after this returns, so the session keeps it; a smaller
    limit that the session has is kept.
    """
    before = spark.conf.get(_BATCH, None) or ""
    if not before.isdigit() or not 0 < int(before) <= size:
        spark.conf.set(_BATCH, str(size))


def release() -> None:
    """Give freed memory back, so that idle workers of earlier stages hold none."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(run: Callable) -> Callable:
    """The function of a mapInArrow, releasing the worker's unused memory at the end of each partition."""

    def released(batches):
        yield from run(batches)
        release()

    return released


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns only, so that other columns can't clash with an operator's own."""
    return df.select(*[df[n] for n in names])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``df`` has no column so named (case aside), for an operator's own columns beside others."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out
