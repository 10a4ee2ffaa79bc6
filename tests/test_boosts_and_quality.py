from tesserine.operators import fusion, packs

HITS = "id int, score double, primary_symbol string, all_symbols array<string>, all_roles array<string>, rel_path string"


def test_symbol_boosts(spark):
    rows = [
        (1, 0.01, "Run", ["Run", "Stop"], ["complete", "mixed"], "cmd/Main.go"), (2, 0.02, "Run", ["Go"], ["mixed"], "b.go"), (3, 0.03, "Old", ["Stop"], ["declaration"], None),
        (4, 0.04, "", None, ["mixed"], "x"), (5, 0.05, None, [None], None, "x"), (6, 0.06, "Old", ["a"], ["mixed"], "y"), (7, 0.07, "", ["b"], ["complete"], "z"), (7, 0.07, None, None, ["declaration", "complete"], "z"),
    ]
    hits = spark.createDataFrame(rows, HITS)
    got = fusion.symbol_boosts(hits, ["Run", "Stop", "", "Run"], ["MAIN", ""])
    assert got.columns == hits.columns
    added = {1: 0.25 + 0.15 + 0.10 + 0.10 - 0.05, 2: 0.25 - 0.05, 3: 0.15 + 0.05, 4: 0, 5: 0, 6: 0, 7: 0.10}
    out = got.collect()
    assert len(out) == len(rows) and all(abs(r.score - r.id / 100 - added[r.id]) < 1e-12 for r in out)
    assert {r.id: round(r.score, 9) for r in fusion.symbol_boosts(hits, [], []).collect()}[3] == 0.08


def test_seven_quality_issues(spark):
    schema = "n_tokens int, text string, summary_en string, keywords_en array<string>"
    rows = [(9, "f() }", "s" * 20, ["a", "b", "c"]), (10, " ", "short", ["a"]), (1001, "return x\n", None, []), (1000, "x;", "", None), (None, None, None, None)]
    got = {r.issue: r.n for r in packs.quality_issues(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"tiny": 2, "huge": 1, "empty": 2, "incomplete": 1, "missing_summary": 3, "short_summary": 1, "few_keywords": 1}
    assert packs.quality_issues(spark.createDataFrame([(50, "x;", None, None)], schema)).count() == 0
