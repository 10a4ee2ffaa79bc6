import json

from pyspark.sql import functions as F

from tesserine.operators import gates, models, rules

CHUNK = "path string, chunk_id string, start_line int, ast_path string, text string, core string, header_context string, summary_1l string, qa_terms string, imports_used array<string>, symbols_defined array<string>, symbols_referenced array<string>, neighbors struct<prev:string,next:string>"


def chunk(n, ast="go:function:Run", path="a.go", **other):
    base = {"path": path, "chunk_id": f"{path}#{n}", "start_line": n, "ast_path": ast, "text": "package p\nx", "core": "x", "header_context": 'package p\n\nimport "fmt"', "summary_1l": "", "qa_terms": None, "imports_used": ["fmt"], "symbols_defined": ["Run"], "symbols_referenced": ["fmt.Println"], "neighbors": (None, None)}
    return tuple((base | other).values())


def good():
    ids = [f"a.go#{n}" for n in (1, 2, 3)]
    return [chunk(1, rules.HEADER, neighbors=(None, ids[1])), chunk(2, neighbors=(ids[0], ids[2])), chunk(3, "go:method:(*T).Do", neighbors=(ids[1], None))]


def codes(spark, rows):
    return sorted(r.code for r in rules.violations(spark.createDataFrame(rows, CHUNK)).collect())


def test_rules(spark):
    assert codes(spark, good()) == [] and codes(spark, []) == []
    broken = {
        "GO_AST_PATH_FORMAT": {"ast": "go:type:lower"}, "GO_HEADER_CONTEXT_PACKAGE": {"header_context": 'import "fmt"'}, "GO_IMPORTS_BUILTIN_LEAK": {"imports_used": ["error"], "header_context": 'package p\nimport "error"'},
        "GO_IMPORTS_MINIMAL_ALPHABETICAL": {"imports_used": ["b", "a"], "header_context": "package p\nimport ("}, "GO_SYMBOLS_DEFINED_PRESENT": {"symbols_defined": None}, "GO_SYMBOLS_SELF_REFERENCE": {"symbols_referenced": ["Run"]},
        "GO_SYMBOLS_QUALIFIED_PREF": {"symbols_referenced": ["a.B", "B"]}, "GO_NO_EMPTY_CHUNKS": {"core": " "}, "GO_QA_TERMS_COUNT_RANGE": {"qa_terms": "a, b,, c"}, "GO_NEIGHBOR_CHAIN": {"neighbors": ("a.go#1", "a.go#9")},
    }
    for code, change in broken.items():
        rows = good()
        rows[1] = chunk(2, **({"neighbors": ("a.go#1", "a.go#3")} | change))
        assert codes(spark, rows) == [code], code
    assert codes(spark, good()[1:])[:2] == ["GO_HEADER_PRESENT_FIRST"] * 2
    slash = [chunk(1, rules.HEADER, path="/b.go", chunk_id="b")]
    assert codes(spark, slash) == ["GO_PATH_ID_NORMALIZED"] * 2
    assert codes(spark, [tuple(None for _ in good()[0])]).count("GO_NO_EMPTY_CHUNKS") == 1


def test_repairs(spark):
    rows = [chunk(5, rules.HEADER), chunk(2, header_context="", imports_used=["b", "error", "a"], symbols_referenced=["Run", "a.B", "B"]), chunk(9, core="")]
    got = {r.start_line: r for r in rules.repaired(spark.createDataFrame(rows, CHUNK)).collect()}
    assert set(got) == {5, 2} and got[5].neighbors.prev is None and got[2].neighbors.prev == "a.go#5"
    assert got[2].header_context == "package p" and got[2].imports_used == ["a", "b"] and got[2].symbols_referenced == ["a.B"]


def test_gates(spark):
    hits = spark.createDataFrame([(1, 1, "how login works", "Login page works"), (1, 2, "how login works", "LOGIN"), (1, 20, "how login works", "x"), (2, 1, "how the", "x"), (3, 1, "token cache size", None)], "query_id int, rank int, question string, text string")
    assert {r.query_id: r.passes for r in gates.relevance(hits, ["login"]).collect()} == {1: True, 2: False, 3: False}
    assert all(r.passes for r in gates.relevance(hits, []).collect())
    assert {r.query_id: (r.n_found, r.passes) for r in gates.evidence_overlap(hits).collect()} == {1: (2, True), 2: (0, True), 3: (0, False)}
    answers = spark.createDataFrame([("# T\na [r/p.go:1-2]\n\n```\nb [r/p.go:3-4] ",), ("a\nb [r/p.go:1-2]",), ("",), (None,)], "a string")
    assert [r.v for r in answers.select(gates.valid_answer(F.col("a")).alias("v")).collect()] == [True, False, False, False]
    topic = spark.createDataFrame([("Fix my LOGIN",), ("the log",), ("none",), (None,)], "q string").select(gates.topic_terms(F.col("q"), {"auth": ["login", "token"], "logs": ["log"]}).alias("t")).collect()
    assert [r.t for r in topic] == [["login", "token"], ["log"], [], []]
    said = spark.createDataFrame([("plain words",), ("het is een test",), ("",), ("äöüß",)], "s string").select(gates.english(F.col("s"), ["het", "is", "een"]).alias("e"), gates.valid_summary(F.col("s")).alias("v")).collect()
    assert [r.e for r in said] == [True, False, True, False] and [r.v for r in said] == [True, True, False, False]


def test_models(spark):
    def _embedder():
        def model(texts):
            if any(len(t) > 4 for t in texts) or "bad" in texts:
                raise ValueError("too long")
            return [[len(t), 1.0] for t in texts]

        return model

    def _filterer():
        seen = set()

        def model(prompts):
            out = []
            for p in prompts:
                out.append(json.dumps({"score": int(p[-1]), "why": "y" * 200}) if p[-1].isdigit() and p in seen | {p} and not (p.startswith("slow") and p not in seen) else "oops")
                seen.add(p)
            return out

        return model

    def _lengths():
        return lambda texts: [float(len(t)) for t in texts]

    texts = spark.createDataFrame([(1, "abcdefgh"), (2, None), (3, "bad")], "id int, text string").coalesce(1)
    got = {r.id: r for r in models.embed(texts.where("id < 3"), _embedder, caps=(10, 4)).collect()}
    assert got[1].embedding == [4.0, 1.0] and got[2].embedding == [0.0, 1.0] and got[1].error is None
    lost = models.embed(texts.where("id = 3"), _embedder).first()
    assert lost.embedding is None and "too long" in lost.error and models.embed(texts.limit(0), _embedder).count() == 0
    rows = spark.createDataFrame([(1, "p3", "x"), (2, "slow4", "x"), (3, "p9", "x"), (4, "never", "password = 'abc'"), (5, "p?", None)], "id int, prompt string, text string").coalesce(1)
    scored = {r.id: (r.filter_score, r.why) for r in models.filter_scores(rows, _filterer).collect()}
    assert scored == {1: (3, "y" * 100), 2: (4, "y" * 100), 3: (0, "invalid reply"), 4: (0, "secret"), 5: (0, "invalid reply")}
    pool = spark.createDataFrame([("q", i, i, "x" * i) for i in (1, 2, 3, 4)], "query_id string, id int, rank int, pair_text string")
    assert [r.id for r in models.rerank(pool, _lengths, most=3).orderBy("rerank_rank").collect()] == [3, 2, 1, 4]
    assert [r.id for r in models.rerank(pool, None).orderBy("rerank_rank").collect()] == [1, 2, 3, 4]
    waits, calls = [], []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert models.with_retries(flaky, sleep=waits.append)("p") == "ok" and waits == [0.5, 1.0]


def test_cache(spark):
    cache = spark.createDataFrame([("a", "old", 1, 5), ("a", "new", 2, 50), ("b", "gone", 1, 5), ("c", "kept", 1, None)], "cache_key string, value string, created_at int, expires_at int")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), (None,)], "cache_key string")
    got = {r.cache_key: (r.hit, r.value) for r in models.cached(keys, cache, F.lit(10)).collect()}
    assert got == {"a": (True, "new"), "b": (False, None), "c": (True, "kept"), "d": (False, None), None: (False, None)}


def test_a_file_of_many_chunks(spark):
    """Neighbours are found in range parts: no window holds a file, and no text is written with the rows."""
    n = 300
    rows = [chunk(i // 2, **({"ast": rules.HEADER} if i == 0 else {}), chunk_id=f"a.go#{i:04}", neighbors=(f"a.go#{i - 1:04}" if i else None, f"a.go#{i + 1:04}" if i < n - 1 else None)) for i in range(n)]
    wrong = rows[:150] + [chunk(75, chunk_id="a.go#0150", neighbors=("a.go#0149", None))] + rows[151:]
    found = rules.violations(spark.createDataFrame(wrong, CHUNK))
    assert [(r.chunk_id, r.code, r.message) for r in found.collect()] == [("a.go#0150", "GO_NEIGHBOR_CHAIN", "next should be a.go#0151, got null")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "__first" not in line and "__n" not in line]
    assert windows and all("__part" in line for line in windows) and "header_context" not in plan.split("Window [", 1)[1].split("Aggregate", 1)[0]
