from tesserine.operators import packs

SCHEMA = "q int, repo_id string, rel_path string, start_line int, end_line int, primary_symbol string, primary_kind string, all_roles array<string>, summary_en string, language string, text string"


def test_evidence_keeps_10000_characters_and_marks_the_cut(spark):
    rows = [(1, "r", "p.go", 3, 9, "A", "func", ["complete", "mixed"], " Does\nA. ", "Go", "\n" + "x" * 10_001 + "\n"), (1, "r", "q", 20, 21, None, None, None, "", "Text", "y" * 10_000)]
    rows += [(2, "r", "p", i, i, "s", "k", [], None, None, str(i)) for i in range(15)]
    got = {r.q: r.evidence for r in packs.evidence(spark.createDataFrame(rows, SCHEMA), "q", ["start_line"]).collect()}
    first = "[1] r | p.go | L3–9 | A (func/complete,mixed)\nsummary: Does A.\ncode:\n```go\n" + "x" * 10_000 + "\n// … trimmed due to size …\n```\n"
    assert got[1] == "EVIDENCE\n--------\n" + first + "\n[2] r | q | L20–21 |  (/n/a)\ncode:\n```\n" + "y" * 10_000 + "\n```\n"
    assert "[12] " in got[2] and "[13] " not in got[2] and got[2].index("[2] ") < got[2].index("[10] ")
