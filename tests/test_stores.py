"""The upsert log's compaction and the embedding sink, interrupted and taken up again; distributed listings."""

import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tesserine.operators import models, sink
from tesserine.sources import files, trees
from tesserine.streaming import upsert

SCHEMA = StructType().add("id", "string").add("version", "long").add("text", "string")


def contents(log, **options):
    return sorted((r.id, r.version, r.text) for r in log.read(**options).collect())


def test_compaction(spark, tmp_path, monkeypatch):
    log = upsert.UpsertLog(spark, str(tmp_path / "log"), SCHEMA, "id", "version", buckets=4)
    assert contents(log) == [] and not log.compact()
    draw, want = random.Random(3), {}
    for number in range(9):
        rows = [(f"k{draw.randrange(30)}", draw.randrange(5), f"{number}") for _ in range(12)]
        log.append(spark.createDataFrame(rows, SCHEMA), number)
        for key in {r[0] for r in rows}:
            best = max(v for k, v, _ in rows if k == key)
            if best >= want.get(key, (-1,))[0]:
                want[key] = (best, str(number))
        expected = sorted((k, *v) for k, v in want.items())
        assert contents(log) == expected
        if number % 2:
            before = log.manifest()
            with monkeypatch.context() as m:  # the run is written, the manifest isn't
                m.setattr(files, "publish_json", lambda *a: (_ for _ in ()).throw(OSError("lost")))
                with pytest.raises(OSError, match="lost"):
                    log.compact(fanout=2)
            assert log.manifest() == before and contents(log) == expected
            assert log.compact(fanout=2) and contents(log) == expected
    assert log.manifest()["covered"] == 7 and max(r["level"] for r in log.manifest()["runs"]) > 1
    log.append(spark.createDataFrame([("k1", 99, "a replay of a batch that a run holds")], SCHEMA), 3)
    (tmp_path / "log/batch=20/bucket=0").mkdir(parents=True)  # a batch that was cut off
    assert contents(log) == expected
    assert log.compact(whole=True) and len(log.manifest()["runs"]) == 1 and contents(log) == expected
    assert "Exchange" not in log.read()._jdf.queryExecution().executedPlan().toString()
    plan = log.read(keys=["k1", "k2"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert contents(log, keys=["k1", "k2", "none"]) == [x for x in expected if x[0] in ("k1", "k2")] and contents(log, keys=[]) == []
    assert log.vacuum() > 0 and contents(log) == expected and not log.compact(whole=True)
    log.append(spark.createDataFrame([("new", 1, "x"), (None, 1, "y")], SCHEMA), 21)
    assert contents(log) == sorted([*expected, ("new", 1, "x")])


def test_only_one_manifest_of_a_number(spark, tmp_path):
    assert files.publish_json(spark, f"{tmp_path}/m/1.json", {"a": 1}) and not files.publish_json(spark, f"{tmp_path}/m/1.json", {"a": 2})
    assert files.read_json(spark, f"{tmp_path}/m/1.json") == {"a": 1} and files.children(spark, f"{tmp_path}/m") == ["1.json"]


def failing():
    """A factory of a model that fails on texts of more than 10 characters and on one of them always; nested, so that workers needn't import this file."""

    def factory():
        def model(texts):
            if any("never" in t or len(t) > 10 for t in texts):
                raise RuntimeError("too long")
            return [[float(len(t))] for t in texts]

        return model

    return factory


def test_sink_is_taken_up_again(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(i, "x" * (i % 14)) for i in range(60)] + [(99, "never"), (None, "no key"), (98, None)], "id long, text string")
    store = sink.EmbeddingSink(spark, str(tmp_path / "sink"), rows.schema)
    real, calls = models.embed, []

    def dies(*args):
        calls.append(1)
        if len(calls) > 2:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(models, "embed", dies)
    with pytest.raises(KeyboardInterrupt):
        store.run(rows, failing(), windows=5, caps=(30, 8, 5))
    monkeypatch.setattr(models, "embed", real)
    half = store.written().count()
    assert 0 < half < 62 and store.pending(rows).count() == 62 - half
    os.makedirs(tmp_path / "sink/run=1/window=4/kind=vector")  # the window that was being written
    assert store.run(rows, failing(), windows=5, caps=(30, 8, 5)) > 0
    held = store.written().collect()
    assert len(held) == len({r.id for r in held}) == 62 and store.pending(rows).count() == 0
    assert {(r.id, r.cap) for r in store.vectors().where("id < 60").collect()} == {(i, 8 if i % 14 > 10 else 30) for i in range(60)}
    assert [(r.id, r.error) for r in store.dead_letters().collect()] == [(99, "RuntimeError: too long")]
    assert store.progress().agg(F.sum("vectors"), F.sum("dead")).first()[:] == (61, 1) and store.run(rows, failing()) == 0
    # a changed text is embedded anew, a dead letter when it is asked for
    changed = rows.withColumn("text", F.when(F.col("id") == 1, "now longer").when(F.col("id") == 99, "nev").otherwise(F.col("text")))
    assert store.pending(changed).count() == 2 and store.pending(rows, again=True).count() == 1
    store.run(changed, failing(), windows=2)
    assert {r.id: r.embedding for r in store.vectors().where("id IN (1, 99)").collect()} == {1: [10.0], 99: [3.0]} and store.vectors().count() == 62
    assert [r.error for r in store.dead_letters().collect()] == ["RuntimeError: too long"]  # of the old text


def test_only_the_text_that_fails_is_cut(spark):
    rows = spark.createDataFrame([(1, "a" * 12), (2, "b" * 5), (3, "never"), (4, "c" * 9)], "id int, text string").coalesce(1)
    got = {r.id: (r.embedding, r.cap, r.error) for r in models.embed(rows, failing(), caps=(30, 6)).collect()}
    assert got == {1: ([6.0], 6, None), 2: ([5.0], 30, None), 3: (None, None, "RuntimeError: too long"), 4: ([9.0], 30, None)}


def test_listing_in_tasks(spark, tmp_path):
    draw = random.Random(1)
    for _ in range(150):
        parts = [draw.choice(["a", "b", "node_modules", ".cache1", ".git", "c d", "_e", ".f"]) for _ in range(draw.randint(0, 4))]
        (tmp_path.joinpath(*parts)).mkdir(parents=True, exist_ok=True)
        tmp_path.joinpath(*parts, draw.choice(["x.py", "_y.GO", "README", ".env", "z.tar.gz", "é.js", "a.b.ts"])).write_text("x" * draw.randint(0, 9))
    (tmp_path / "empty").mkdir()
    walked = set()
    for folder, names, found in os.walk(tmp_path):
        names[:] = [n for n in names if n not in trees.EXCLUDED and not n.startswith(".cache")]
        walked |= {(os.path.relpath(f"{folder}/{f}", tmp_path), os.path.getsize(f"{folder}/{f}")) for f in found}
    every = trees.listed_files(spark, str(tmp_path), None)
    assert {(r.rel_path, r.length) for r in every.collect()} == walked
    wanted = {p for p, _ in walked if "." in p.rsplit("/", 1)[-1] and p.rsplit(".", 1)[-1].lower() in trees.EXTENSIONS}
    assert {r.rel_path for r in trees.listed_files(spark, str(tmp_path)).collect()} == wanted
    assert trees.listed_files(spark, str(tmp_path / "empty")).collect() == []


def test_skip_rules(spark):
    cases = {("a/b.go", 5): False, ("a.PNG", 5): True, ("a.tar.gz", 5): True, ("x.py", (1 << 20) + 1): True, ("x.py", 1 << 20): False, ("node_modules/a.js", 5): True, ("coverage/a.py", 5): True, ("b.xyz", 5): True, ("Makefile", 5): True, (".md", 5): True, ("a.GO", 5): True, ("d.r/e", 5): True, ("x/openapi.yaml", 5): False}
    rows = spark.createDataFrame([(p, n, s) for (p, n), s in cases.items()], "p string, n long, s boolean")
    assert rows.where(trees.skipped(F.col("p"), F.col("n")) != F.col("s")).collect() == []
    assert rows.where("p LIKE 'node_modules%'").select(trees.skipped(F.col("p"), F.col("n"), vendor=True)).first()[0] is False
