import json

from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators import guides, models, repos
from tesserine.plans.staging import staged

CHUNK = "repo_id string, rel_path string, chunk_number int, start_line int, end_line int, text string, language string, symbols array<string>"


def at(day="2024-05-01"):
    return F.to_timestamp(F.lit(day))


def packs(spark, **names):
    rows = [(repo, f"pkg/{n}.go", 1, 1, 3, f"package {n}\nfunc {n}() {{\n}}", "go", [n]) for repo, files in names.items() for n in files]
    return staged(repos.guide_pack(spark.createDataFrame(rows, CHUNK)), "packs")


def no_guides(spark):
    return spark.createDataFrame([], guides.GUIDE)


def scripted():
    """A factory, made here so that it is pickled whole: replies by the name of the repository in the prompt."""

    def reply(prompt):
        full = "\nFolders:" in prompt
        if "Repository: broken" in prompt:
            raise RuntimeError("down")
        if "Repository: never" in prompt:
            return "sorry"
        if "Repository: short" in prompt and full:
            return json.dumps({"overview": "  "})
        if "Repository: odd" in prompt:
            return json.dumps({"overview": "x" * 7000, "key_flows": "not a list", "languages": ["go", "GO", " ", *"abcdefgh"], "modules": [f"m{i}" for i in range(20)]})
        return f"Here it is:\n```json\n{json.dumps({'overview': 'fine', 'key_flows': [f'f{i}' for i in range(12)], 'entrypoints': ['main.go']})}\n```"

    return lambda: lambda prompts: [reply(p) for p in prompts]


def test_lanes_and_caps(spark):
    new = guides.written(packs(spark, good=["a"], short=["a"], never=["a"], broken=["a"], odd=["a"]), no_guides(spark), scripted(), at(), attempts=2, wait=0.0)
    got = {r.repo_id: r for r in new.collect()}
    assert {k: r.lane for k, r in got.items()} == {"good": "full", "short": "compact", "never": "failed", "broken": "failed", "odd": "full"}
    assert got["good"].overview == "fine" and got["good"].key_flows.split("\n") == [f"- f{i}" for i in range(8)] and got["good"].languages == ["go"] and got["good"].modules == "pkg" and got["good"].entrypoints == "main.go"
    assert got["broken"].error == "RuntimeError: down" and got["never"].error == "invalid reply" and got["never"].overview is None and got["good"].error is None
    odd = got["odd"]
    assert len(odd.overview) == 6000 and odd.languages == ["go", "a", "b", "c", "d", "e"] and odd.modules == ", ".join(f"m{i}" for i in range(10)) and odd.key_flows == ""


def test_unchanged_packs_are_not_asked_again(spark):
    first = staged(guides.merged(no_guides(spark), guides.written(packs(spark, good=["a"], short=["a"], never=["a"]), no_guides(spark), scripted(), at(), 1, 0.0)), "stored")
    assert {r.repo_id for r in first.collect()} == {"good", "short"}
    later = staged(guides.written(packs(spark, good=["a", "b"], short=["a"]), first, scripted(), at("2024-06-01"), 1, 0.0), "later")
    assert [r.repo_id for r in later.collect()] == ["good"]
    months = {r.repo_id: r.updated_at.month for r in guides.merged(first, later).collect()}
    assert months == {"good": 6, "short": 5}


def test_a_failed_guide_leaves_what_is_stored(spark):
    stored = spark.createDataFrame([("never", "old", "", "", [], "", "other", None)], guides.GUIDE)
    new = guides.written(packs(spark, never=["a"]), stored, scripted(), at(), 1, 0.0)
    assert [r.overview for r in guides.merged(stored, new).collect()] == ["old"]


def test_fetched_and_missing(spark):
    stored = spark.createDataFrame([("r", "about", "- f", "main.go", ["go"], "pkg", "x", None)], guides.GUIDE)
    wanted = spark.createDataFrame([(1, "r", "q"), (2, "none", "q"), (3, None, "q")], "place int, repo_id string, overview string")
    got = {r.place: r for r in guides.fetched(wanted, stored).collect()}
    assert (got[1].found, got[1].overview, got[1].languages) == (True, "about", ["go"])
    assert all((got[n].found, got[n].overview, got[n].languages) == (False, "", []) for n in (2, 3))


def test_no_packs(spark):
    assert guides.written(packs(spark, good=["a"]).where("false"), no_guides(spark), scripted(), at()).count() == 0


def test_prompts_are_bounded(spark):
    rows = [("r", f"d{i % 40}/f{i}.go", 1, 1, 200, "\n".join(f"line {n} of {i}" for n in range(200)), "go", []) for i in range(60)]
    full, compact = repos.guide_pack(spark.createDataFrame(rows, CHUNK)).select(guides.prompt(), guides.prompt(files=6, heads=3, head_lines=30, tree_lines=0)).first()
    assert full.count("line ") == 200 and compact.count("line ") == 90 and full.count("```go") == 4 and compact.count("```go") == 3
    folders = full.split("Folders:\n")[1].split("\n\n")[0].split("\n")
    assert "Folders" not in compact and sum(x.startswith(("d", "  - ")) and "[" not in x for x in folders) == 20


def test_json_objects():
    assert models.json_object('```json\n{"a": {"b": 1}}\n```') == {"a": {"b": 1}}
    assert models.json_object('so: {"a": 1} done') == {"a": 1}
    for bad in (None, "", "[1]", "{", "{'a': 1}", "}{"):
        assert models.json_object(bad) is None


def test_one_failing_prompt_does_not_cut_the_window(spark):
    def flaky():
        seen = {}

        def model(prompts):
            for p in prompts:
                seen[p] = seen.get(p, 0) + 1
                if p == "bad" or (p == "late" and seen[p] < 3):
                    raise ValueError(p)
            return [json.dumps({"x": p}) for p in prompts]

        return model

    rows = spark.createDataFrame([(i, p, None) for i, p in enumerate(["a", "bad", "late", None, "b"])], "id int, p string, q string").coalesce(1)
    got = {r.id: (r.reply and json.loads(r.reply)["x"], r.step, r.error) for r in models.ask_json(rows, flaky, ["p", "q"], "x", attempts=4, wait=0.0).collect()}
    assert got == {0: ("a", 1, None), 1: (None, None, "ValueError: bad"), 2: ("late", 1, None), 3: (None, None, "no prompt"), 4: ("b", 1, None)}


def test_normalized_lists(spark):
    df = spark.createDataFrame([([" Go", "go", "", None, "Py", "GO", "ts"],), (None,), ([],)], "x array<string>")
    assert [r[0] for r in df.select(T.normalized_list(F.col("x"))).collect()] == [["Go", "Py", "ts"], [], []]
    assert df.select(T.normalized_list(F.col("x"), 3)).first()[0] == ["Go", "Py"]
