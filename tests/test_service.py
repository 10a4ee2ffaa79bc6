"""The search service, the filter-rerank-answer plan, enrichment, tables and reports on fixtures, with stand-ins for models."""

import json

import pytest
from pyspark.sql import functions as F

from tesserine.functions import chunkers
from tesserine.operators import answers, enrich, postings, rag, repos, service
from tesserine.plans import report
from tesserine.sources import tables

CHUNK = "id long, repo_id string, rel_path string, language string, primary_symbol string, all_symbols array<string>, all_roles array<string>, start_line int, end_line int, summary_en string, text string"


@pytest.fixture(scope="module")
def searched(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('index')}"
    words = ["login token", "cache eviction", "rate limit", "login page", "token refresh login", "unrelated words"]
    rows = [(i, f"r{i % 2}", f"src/f{i}.go", "go", f"Sym{i}", [f"Sym{i}"], ["complete"], 1, 9, f"About {w}", f"func Sym{i}() {{ // {w}\n}}") for i, w in enumerate(words)]
    chunks = spark.createDataFrame(rows, CHUNK)
    postings.build(chunks, "id", {"text": F.col("text"), "summary_en": F.col("summary_en"), "primary_symbol": F.col("primary_symbol")}, f"{path}/chunks")
    vectors = spark.createDataFrame([(i, [1.0, 0.0] if "login" in w else [0.0, 1.0]) for i, w in enumerate(words)], "id long, embedding array<float>")
    routers = spark.createDataFrame([("r0", "Zero", "login"), ("r1", "One", "cache")], "repo_id string, short_title string, summary string")
    postings.build(routers.withColumn("domains", F.lit("")), "repo_id", {c: F.col(c) for c in ("short_title", "summary")}, f"{path}/routers")
    return service.Service(chunks, vectors, postings.Index(spark, f"{path}/chunks"), _embed, routers, routers.where("repo_id = 'r0'").select("repo_id"), postings.Index(spark, f"{path}/routers"))


def _embed(text):
    return [2.0, 0.0] if "login" in text else [0.0, 2.0]


# lambdas are sent by value, as workers don't import the tests
RATE = lambda: lambda prompts: [json.dumps({"score": 4 if "login" in p.split("File:")[1] else 0, "why": "words"}) for p in prompts]
CITE = lambda: lambda prompts: ["It is here. [1][2]" for _ in prompts]


def test_search_routes_and_ranks(searched):
    assert searched.route("login") == ["r0"] and searched.route("x", "r1") == ["r1"] and searched.route("zebra") == []
    hits = searched.search("where is the login token", repo=None).orderBy("rank").collect()
    assert {h.repo_id for h in hits} == {"r0"} and hits[0].id == 0 and hits[0].text and hits[0].score > hits[-1].score
    assert {h.repo_id for h in searched.simple_search("login", "r1").collect()} == {"r1"}
    assert len(searched.search("zebra", all_texts=True).where("text IS NULL").collect()) == 0
    only = searched.search("login", semantic_only=True).collect()
    assert {h.id for h in only if h["rank"] <= 2} == {0, 4}
    assert [r.short_title for r in searched.repositories().collect()] == ["Zero", "One"] and searched.health()["status"] == "ok"
    assert [r.repo_id for r in searched.missing_guides(["r0", "r1"]).collect()] == ["r1"]
    assert searched.context(["r0"]).first().summary == "login"


def test_filter_rerank_answer(spark, searched):
    row = searched.ask("where is the login token", CITE, RATE, lambda: lambda texts: [float("token" in t.split("\n", 1)[1]) for t in texts]).first()
    assert row.answer == "It is here. [1][2]" and row.recalled == 3 and row.kept == 3 and row.evidence.startswith("EVIDENCE")
    assert row.evidence.index("f4.go") < row.evidence.index("f2.go")
    plain = searched.ask("where is the login token", CITE).first()
    assert plain.citations == [1, 2]
    nothing = rag.answered(spark.createDataFrame([("q", "q")], "query string, question string"), searched.recall("x").limit(0), RATE, None, CITE).first()
    assert nothing.recalled == 0 and nothing.answer.startswith("No relevant chunks")


def test_few_survivors_fall_back_to_recall(spark):
    rows = spark.createDataFrame([("q", i, i + 1, 1 - i / 10, 4 if i == 5 else 0) for i in range(6)], "query string, id int, rank int, retriever_score double, filter_score int")
    got = rag.survivors(rows).orderBy("rank").collect()
    assert [r.id for r in got] == list(range(6)) and {r.lane for r in got} == {"baseline"} and {r.filter_score for r in got} == {1}


def test_answers_are_guarded(spark):
    sources = spark.createDataFrame([("a", 1, "r", "x.go", 1, 2, "code")], "query string, rank int, repo_id string, rel_path string, start_line int, end_line int, code string")
    questions = spark.createDataFrame([("a", "A?"), ("b", "B?")], "query string, question string")
    good = {r.query: r for r in answers.answered(questions, sources, lambda: lambda ps: ["It is. [r|x.go:1-2]" for _ in ps]).collect()}
    assert good["a"].valid and good["a"].answer.startswith("It is.") and "**Spotlight (auto)**" in good["a"].answer and good["b"].answer == answers.NOT_FOUND
    bad = {r.query: r for r in answers.answered(questions, sources, lambda: lambda ps: ["It is." for _ in ps]).collect()}
    assert not bad["a"].valid and bad["a"].answer == answers.NOT_FOUND
    free = {r.query: r for r in answers.answered(questions, sources, lambda: lambda ps: ["It is." for _ in ps], guards=False, spotlight=0).collect()}
    assert free["a"].answer == free["b"].answer == "It is."
    said = spark.createDataFrame([("a", "No cite.", "x.go"), ("b", "Cited [r|x:1-2]", "x.go")], "query string, answer string, listed string")
    fixed = {r.query: r.answer for r in answers.repaired(said, "listed", lambda: lambda ps: ["Now [r|x:3-4]" for _ in ps]).collect()}
    assert fixed == {"a": "Now [r|x:3-4]", "b": "Cited [r|x:1-2]"}


def test_settings_are_checked():
    assert service.Settings().threshold == 3
    for wrong in ({"threshold": 5}, {"min_survivors": 0}, {"variance_bypass": 1.5}, {"hybrid_alpha": -0.1}):
        with pytest.raises(ValueError):
            service.Settings(**wrong)
    assert rag.table_of("v4") == "chunks_v4" and rag.table_of("v2", "router") == "router_v2"
    with pytest.raises(ValueError):
        rag.table_of("v9")


def test_enrichment_caches_what_it_asked(spark):
    fields = "id int, rel_path string, text string, node_kind string, primary_symbol string, receiver string, symbols array<string>, synopsis string, summary_en string, keywords_en array<string>"
    chunks = spark.createDataFrame([(1, "a.go", "x", "function", "Run", "", ["Order"], "", None, None), (2, "a.go", "y", "function", "Go", "", [], "", None, None), (3, "a.go", "z", "type", "T", "", [], "", "Had one.", ["k"])], fields)
    empty = spark.createDataFrame([], "cache_key string, value struct<summary:string,keywords:array<string>>")
    model = lambda: lambda ps: [json.dumps({"summary_en": "Runs orders.", "keywords_en": ["order book"]}) if "\nx\n" in p else "é" for p in ps]
    first = enrich.enriched(chunks, empty, model)
    got = {r.id: (r.lane, r.summary_en) for r in first.collect()}
    assert got == {1: ("model", "Runs orders"), 2: ("fallback", "Function Go — code."), 3: ("kept", "Had one.")} or got[2][1].startswith("Function Go")
    entries = enrich.to_cache(first, F.lit("2024-01-01").cast("timestamp"), "1 DAY")
    assert entries.count() == 2
    again = enrich.enriched(chunks, entries, lambda: (_ for _ in ()).throw(AssertionError("asked twice")))
    assert {r.lane: r.n for r in enrich.lanes(again).collect()} == {"cached": 2, "kept": 1}
    assert {r.lane: r.n for r in enrich.lanes(enrich.enriched(chunks, empty, model, dry_run=True)).collect()} == {"pending": 2, "kept": 1}
    newer = entries.withColumn("created_at", F.lit("2024-02-01").cast("timestamp"))
    assert {r.created_at.month for r in enrich.merged_cache(entries, newer).collect()} == {2}


def test_tables_and_reports(spark):
    name = "tesserine_test_chunks"
    try:
        assert tables.create_table(spark, name, force=True) and not tables.create_table(spark, name)
        tables.append(spark.createDataFrame([("a", [1.0, 2.0])], "id string, embedding array<double>"), name, 2)
        with pytest.raises(Exception, match="dimensions"):
            tables.append(spark.createDataFrame([("b", [1.0])], "id string, embedding array<double>"), name, 2)
        assert tables.sample_one(spark.table(name), "id", "repo_id") == {"id": "a", "repo_id": None} and tables.statistics(spark.table(name)).first().rows == 1
        assert tables.cache_table(spark, None).count() == 0
    finally:
        assert tables.drop_table(spark, name) and not tables.drop_table(spark, name)
    rows = spark.createDataFrame([(i, f"f{i % 2}.go", i, i + 1, "a < b", "func", "type", 10 * i) for i in range(5)], "id int, rel_path string, start_line int, end_line int, summary_en string, text string, node_kind string, n_tokens int")
    page = report.html_report(rows, most=3)
    assert "a &lt; b" in page and page.count("<section>") == 3 and "chunks: 5" in page
    assert report.chosen(rows, path="f1", least_tokens=20, sample=9).count() == 1 and report.chosen(rows, no_summary=True).count() == 0
    assert report.difference("a\nb", "a\nc").endswith("-b\n+c") and report.difference("a", "a") == ""


def test_bounded_chunks_and_bodies():
    text = "package a\n\nimport \"x\"\n\n// A does\nfunc A() {\n a b c\n d e f\n}\n\nfunc B() {\n x\n}\n"
    assert [c[1:3] for c in chunkers.bounded_chunks(text, "go", 1000)] == [(1, 14)]
    assert [c[1:3] for c in chunkers.bounded_chunks(text, "go", 20)] == [(1, 4), (5, 10), (11, 14)]
    assert "\n".join(c[3] for c in chunkers.bounded_chunks(text, "go", 8)) == text
    assert chunkers.count_tokens("a.b c") == 4 and chunkers.count_tokens("abc", list) == 3
    assert [(c["start_line"], c["end_line"]) for c in chunkers.text_chunks(text, "Go")] == [(1, 2), (3, 4), (5, 10), (11, 14)]
    body = "\n".join(["func A() {"] + [f" x{i}()" for i in range(9)] + [" if x {", "  y", " }", " z()"] + [f" w{i}()" for i in range(30)] + ["}"])
    parts = chunkers.split_body(body, 5)
    assert "\n".join(p[2] for p in parts) == body and parts[0][1] == 10 and all(b - a <= 25 for a, b, _ in parts)
    assert chunkers.split_body("a", 5) == [(1, 1, "a")]


def test_router_documents(spark):
    chunks = spark.createDataFrame([("my-repo", "src/main.py", 0, 1, 2, "a b", "python", ["Run", "the"]), ("my-repo", "x.go", 0, 1, 2, None, None, [])], "repo_id string, rel_path string, chunk_number int, start_line int, end_line int, text string, language string, symbols array<string>")
    packs = repos.router_pack(chunks)
    given = spark.createDataFrame([("my-repo", " Title ", " ")], "repo_id string, short_title string, summary string")
    doc = repos.described(packs, given).first()
    assert doc.short_title == "Title" and doc.summary and doc.languages == ["python"] and "Run" in doc.key_symbols
    stored = repos.file_guides(chunks).where("rel_path = 'x.go'")
    assert [r.rel_path for r in repos.changed(repos.file_guides(chunks), stored, ["repo_id", "rel_path"], "excerpt_sha1").collect()] == ["src/main.py"]


def test_models_are_asked_in_windows(spark):
    """However many rows a batch has, a model and its worker hold a bounded number of prompts, and nothing of a row but its prompt."""
    from pyspark.sql.types import StringType, StructType

    def model():
        def ask(prompts):
            assert len(prompts) <= 256
            return ["{}" if "\n1" in p and enrich.TIGHTEN not in p else json.dumps({"summary_en": "Runs orders.", "keywords_en": ["order book"]}) for p in prompts]

        return ask

    rows = spark.range(3000).coalesce(1).selectExpr("id", "concat('ask', char(10), id) AS prompt", "repeat('x', 100) AS text")
    got = enrich._asked(rows, model)
    assert got.schema["summary"].dataType == StringType() and isinstance(got.schema, StructType)
    assert {(r.summary, tuple(r.keywords)) for r in got.collect()} == {("Runs orders.", ("order book",))} and got.count() == 3000
    assert "ArrowEvalPython" in got._jdf.queryExecution().executedPlan().toString()


def test_semantic_search_builds_no_index(spark, monkeypatch):
    from tesserine.queries import service as queries

    monkeypatch.setattr(queries, "index_of", lambda *_: pytest.fail("an index that nothing reads"))
    assert [r["rank"] for r in queries.semantic_search(spark, "/root/testdata/sf0.001").orderBy("rank").collect()] == [1, 2, 3, 4, 5]
