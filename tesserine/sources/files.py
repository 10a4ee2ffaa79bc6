"""The few operations on a table's folder that DataFrames don't have, through Spark's own file systems."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it doesn't exist."""
    fs, where = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def read_json(spark: SparkSession, path: str) -> dict:
    """A small file, a JSON object."""
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish_json(spark: SparkSession, path: str, value: dict) -> bool:
    """Write a small file whole or not at all; False if another writer was first.

    It is written under another name, then renamed, which the file systems of HDFS and local
    disks do atomically and not over an existing file. Stores without such a rename need one
    writer at a time.
    """
    fs, where = _at(spark, path)
    _, other = _at(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(other, False)
    try:
        out.write(bytearray(json.dumps(value).encode()))
    finally:
        out.close()
    if not fs.exists(where) and fs.rename(other, where):
        return True
    fs.delete(other, False)
    return False
