import json

from pyspark.sql.types import StructType

from tesserine.streaming import upsert

SCHEMA = StructType().add("id", "string").add("version", "long").add("text", "string")


def test_upsert_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    log = upsert.UpsertLog(spark, str(tmp_path / "table"), SCHEMA, "id", "version", buckets=2)

    def feed(name, *rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps(dict(zip(("id", "version", "text"), r, strict=True))) for r in rows))
        log.attach(upsert.read_json_stream(spark, str(tmp_path / "in"), SCHEMA), str(tmp_path / "check")).awaitTermination()
        return {r.id: (r.version, r.text) for r in log.read().collect()}

    assert feed("1", ("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z"), (None, 1, "n")) == {"a": (2, "z"), "b": (1, "y")}
    # an older version loses, an equal one of a later batch wins, and a replay of a batch changes nothing
    second = feed("2", ("a", 1, "late"), ("b", 1, "again"), ("c", 9, None))
    assert second == {"a": (2, "z"), "b": (1, "again"), "c": (9, None)}
    log.append(spark.createDataFrame([("a", 1, "late"), ("b", 1, "again"), ("c", 9, None)], SCHEMA), 1)
    assert {r.id: (r.version, r.text) for r in log.read().collect()} == second


def test_first_seen(spark, tmp_path):
    schema = StructType().add("k", "string").add("at", "timestamp")
    (tmp_path / "a.json").write_text('{"k": "x", "at": "2024-01-01T00:00:00Z"}\n{"k": "x", "at": "2024-01-01T01:00:00Z"}\n{"k": "y", "at": "2024-01-01T00:30:00Z"}\n')
    stream = upsert.first_seen(upsert.read_json_stream(spark, str(tmp_path), schema), "k", "at")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y"]


def test_ttl_cache(spark, tmp_path):
    """Hits until an entry expires by event time, over micro-batches and a restart."""
    from tesserine.streaming import cache

    schema = StructType().add("cache_key", "string").add("seq", "long").add("at", "timestamp").add("op", "string").add("value", "string").add("ttl_ms", "long")
    (tmp_path / "in").mkdir()
    minute = lambda m: f"2024-01-01T{m // 60:02d}:{m % 60:02d}:00Z"

    def feed(name, *rows):
        (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps({"cache_key": k, "seq": i, "at": minute(m), "op": op, "value": v, "ttl_ms": 600_000}) for k, i, m, op, v in rows))
        stream = cache.lookups(upsert.read_json_stream(spark, str(tmp_path / "in"), schema), "30 minutes")
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination()
        return {r.seq: (r.hit, r.value, r.hits, r.misses) for r in spark.read.schema(cache.LOOKUP).parquet(str(tmp_path / "out")).collect()}

    got = feed("1", ("a", 1, 0, "get", None), ("a", 2, 1, "set", "x"), ("a", 3, 5, "get", None), ("b", 4, 5, "get", None), (None, 5, 5, "get", None))
    assert got == {1: (False, None, 0, 1), 3: (True, "x", 1, 1), 4: (False, None, 0, 1)}
    # the entry was set at minute 1 and lives ten minutes; a later set replaces it; ties go by seq
    got = feed("2", ("a", 6, 10, "get", None), ("a", 7, 11, "get", None), ("a", 8, 20, "set", "y"), ("a", 9, 20, "get", None), ("b", 10, 20, "set", None), ("b", 11, 21, "get", None))
    assert [got[i] for i in (6, 7, 9, 11)] == [(True, "x", 2, 1), (False, None, 2, 2), (True, "y", 3, 2), (False, None, 0, 2)]
    # far ahead: timers free the state, and nothing is a hit
    got = feed("3", ("c", 12, 500, "set", "z"))
    got = feed("4", ("a", 13, 501, "get", None), ("c", 14, 505, "get", None), ("a", 15, 1, "get", None))
    assert got[13] == (False, None, 3, 3) and got[14] == (True, "z", 1, 0) and 15 not in got
