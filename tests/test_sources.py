import json

from pyspark.sql import functions as F

from tesserine.functions import chunkers
from tesserine.plans import ingest
from tesserine.sources import chunks, trees

GO = '''package main

import (
	"fmt"
	x "a/b"
)

// T does
// things
type T struct {
	a int
}

type (
	A interface{ F() }
	B = string
)

func (t *T) Run(s string) error {
	return nil // }
}

func main() {
	fmt.Println("{")
}
'''


def tree(root):
    files = {"main.go": GO, "pkg/s.pb.go": "package pkg\n", "node_modules/a.js": "x", ".cache9/b.py": "x", ".github/c.py": "x = 1", "README": "no", "deep/er/d.PY": "import os\n# c\n@dec\ndef f():\n    def g():\n        pass\nclass A:\n    pass\n", "empty.rb": "", "pkg/__init__.py": "x = 1"}
    for name, text in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    (root / "bad.js").write_bytes(b"let a = '\xff';")


def test_source_files(spark, tmp_path):
    tree(tmp_path)
    got = {r.rel_path: r.text for r in trees.source_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"main.go", "pkg/s.pb.go", "pkg/__init__.py", ".github/c.py", "deep/er/d.PY", "empty.rb", "bad.js"}
    assert got["bad.js"] == "let a = '';" and got["empty.rb"] == "" and got["main.go"] == GO
    assert ".github/c.py" not in {r.rel_path for r in trees.source_files(spark, str(tmp_path), dot_folders=False).collect()}
    kind = spark.createDataFrame([("yaml", "openapi: 3"), ("yaml", "a: b"), ("go", "openapi:")], "e string, t string")
    assert [r.v for r in kind.select(trees.file_type(F.col("e"), F.col("t")).alias("v")).collect()] == ["openapi", "yaml", "go"]


def test_chunk_lines_and_go():
    spans = [c[1:3] for c in chunkers.chunk_lines(GO, "go")]
    assert spans == [(1, 2), (3, 7), (8, 13), (14, 18), (19, 22), (23, 26)]
    assert [c[1:3] for c in chunkers.chunk_lines("import os\n# c\n@dec\ndef f():\n    def g():\n        pass\nclass A:\n    pass\n", "py")] == [(1, 1), (2, 6), (7, 9)]
    # comments that reach up to the first line stay with the head; blank, empty and unknown texts are one chunk
    assert [c[1:3] for c in chunkers.chunk_lines("// a\n// b\nfunc f() {}", "go")] == [(1, 2), (3, 3)]
    assert chunkers.chunk_lines("", "go") == [(1, 1, 1, "")] and chunkers.chunk_lines("a\nb", "java") == [(1, 1, 2, "a\nb")]
    deep = "class K {\n function a() {\n  function b() {}\n }\n function c() {}\n}\n"
    assert [c[1:3] for c in chunkers.chunk_lines(deep, "php")] == [(1, 1), (2, 4), (5, 7)]
    long = "// x\n" * 20_000 + "func f() {}\n" * 2
    assert len(chunkers.chunk_lines(long, "go")) == 3
    for text in (GO, long, deep):
        for ext in ("go", "php", "js", "py", "rb", "css"):
            got = chunkers.chunk_lines(text, ext)
            assert "".join("".join(c[3].split()) for c in got) == "".join(text.split())
    found = {(d["kind"], d["name"]): d for d in chunkers.go_declarations(GO)}
    assert set(found) == {("type", "T"), ("type", "A"), ("type", "B"), ("method", "Run"), ("function", "main")}
    assert found["method", "Run"]["receiver"] == "*T" and found["method", "Run"]["end_line"] == 21 and found["type", "A"]["type_kind"] == "interface"
    assert chunkers.go_declarations("type (") == [] and chunkers.go_declarations("") == [] and chunkers.go_declarations("func (") == []


def test_go_context(spark):
    row = spark.createDataFrame([(GO,), ("",)], "t string").select(chunkers.go_package(F.col("t")).alias("p"), chunkers.go_imports(F.col("t")).alias("i"), chunkers.go_aliases(F.col("t")).alias("a")).collect()
    assert row[0].p == "main" and row[0].i == ["a/b", "fmt"] and row[0].a == {"fmt": "fmt", "x": "a/b"}
    assert row[1].p == "" and row[1].i == [] and row[1].a == {}


def test_build_chunks_and_increment(spark, tmp_path):
    tree(tmp_path)
    files = trees.source_files(spark, str(tmp_path))
    got = ingest.build_chunks(files, "r")
    rows = {(r.rel_path, r.chunk_number): r for r in got.collect()}
    run = rows["main.go", 5]
    assert (run.primary_symbol, run.primary_kind, run.package, run.rank_boost) == ("Run", "method", "main", 1.0)
    assert run.neighbors.prev == rows["main.go", 4].id and run.neighbors.next == rows["main.go", 6].id and rows["main.go", 1].neighbors.prev is None
    assert rows["main.go", 4].def_symbols == ["A", "B"] and rows["pkg/s.pb.go", 1].rank_boost == 0.35
    assert len({r.id for r in rows.values()}) == len(rows)
    manifest = files.where("rel_path <> 'main.go'").select("rel_path", F.sha1(F.col("text").cast("binary")).alias("sha"))
    again = ingest.changed(files, manifest)
    assert [r.rel_path for r in again.collect()] == ["main.go"]
    fresh = ingest.refreshed(got, ingest.build_chunks(again, "r"), files.where("rel_path <> 'bad.js'"))
    assert fresh.count() == len(rows) - 1 and fresh.columns == got.columns
    text = "\n".join(str(i) for i in range(120))
    cut = ingest.blocks(spark.createDataFrame([("f", text), ("n", None)], "rel_path string, text string")).collect()
    assert sorted((r.rel_path, r.start_line, r.end_line) for r in cut) == [("f", 1, 50), ("f", 51, 100), ("f", 101, 120), ("n", 1, 1)]


def test_chunk_files(spark, tmp_path):
    good, wrapped = {"id": "a", "path": "p.go", "start_line": 3, "end_line": "9", "text": "x"}, {"_id": 1, "_source": {"id": "b", "rel_path": "q.go", "retriever_score": 0.5}}
    (tmp_path / "l").mkdir()
    (tmp_path / "l/a.jsonl").write_text("\n".join([json.dumps(good), "", "{broken", json.dumps(wrapped), json.dumps({"id": "c", "start_line": "x"})]))
    got = {r.id: r for r in chunks.read_lines(spark, str(tmp_path / "l")).collect()}
    assert set(got) == {"a", "b"} and got["a"].rel_path == "p.go" and (got["a"].start_line, got["a"].end_line) == (3, 9) and got["b"].retriever_score == 0.5 and got["b"].language == ""
    for name, value in {"array": [good, wrapped], "hits": {"hits": [good, wrapped]}, "chunks": {"chunks": [good, wrapped], "results": [good]}}.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
        assert sorted(r.id for r in chunks.read_documents(spark, str(tmp_path / f"{name}.json")).collect()) == ["a", "b"], name
    (tmp_path / "other.json").write_text('{"x": 1}')
    assert chunks.read_documents(spark, str(tmp_path / "other.json")).count() == 0
    try:
        chunks.read_documents(spark, str(tmp_path / "other.json"), strict=True).collect()
        raise AssertionError("an object without hits should fail")
    except Exception as e:
        assert "neither a list" in str(e)
    chunks.write_lines(chunks.read_lines(spark, str(tmp_path / "l")), str(tmp_path / "out"))
    assert chunks.read_lines(spark, str(tmp_path / "out"), strict=True).count() == 2


def test_normalize_and_index(spark, tmp_path):
    rows = spark.createDataFrame([("", "r", "f", 1, "a, b,,", [1, 2], "x"), ("k", "r", "f", 2, None, [1], "  "), ("k", "r", "f", 3, "c", None, None)], "id string, repo_id string, rel_path string, chunk_number int, symbols string, primary_span array<int>, text string")
    got = {r.chunk_number: r for r in chunks.with_ids(chunks.normalized(rows)).collect()}
    assert got[1].id == "r-f-1" and got[1].symbols == ["a", "b"] and got[1].primary_span == [1, 2] and got[2].primary_span is None and got[3].id == "k"
    assert chunks.normalized(rows, drop_blank=True).count() == 1
    assert {r.chunk_number for r in chunks.newest(rows, "id", "chunk_number").collect()} == {1, 3}
    cut = chunks.index_rows(rows, 1).where("chunk_number = 1").first()
    assert cut.embedding_text == "x" and cut.text_hash == cut.embedding_hash
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<float>")
    assert chunks.of_dimension(vectors.limit(1), 2).count() == 1
    try:
        chunks.of_dimension(vectors, 2).collect()
        raise AssertionError("a vector of another length should fail")
    except Exception as e:
        assert "2 components, found 1" in str(e)
    (tmp_path / "q.txt").write_text(" one \n\n two\n")
    (tmp_path / "r.csv").write_text("query,relevant_id\none,b\none,a\none,b\n")
    assert [r.query for r in chunks.read_queries(spark, str(tmp_path / "q.txt")).collect()] == ["one", "two"]
    assert chunks.read_relevant(spark, str(tmp_path / "r.csv")).first().relevant_ids == ["a", "b"]
