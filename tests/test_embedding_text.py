from pyspark.sql import functions as F

from tesserine.functions import text as T

SCHEMA = "repo string, path string, lang string, symbol string, kind string, roles array<string>, summary string, keywords array<string>, doc_head string, text string"


def test_embedding_text_has_all_sections_and_the_end_of_the_text(spark):
    code = "\n  func A() {\n" + "x" * 1500 + "END"
    rows = [("r", "p.go", "go", "A", "func", ["complete", "mixed"], "Does A.", ["a", "b"], "\n func A() \n", code), ("r", None, "go", "", "", [], "", None, None, "y" * 200), (*[None] * 10,)]
    got = [r.v for r in spark.createDataFrame(rows, SCHEMA).select(T.embedding_text(*[F.col(c.split()[0]) for c in SCHEMA.split(", ")]).alias("v")).collect()]
    head = "[repo]: r\n[path]: p.go\n[lang]: go\n[symbol]: A (func)\n[roles]: complete, mixed\n\n[summary]: Does A.\n[keywords]: a, b\n\n[signature]:\nfunc A()\n\n[code]:\n"
    assert got[0] == head + code[:840] + "\n...\n" + code[-300:]
    assert got[1] == "[repo]: r\n[path]: \n[lang]: go\n[symbol]:  ()\n\n[signature]:\n" + "y" * 200 + "\n\n[code]:\n" + "y" * 200
    assert got[2] == "[repo]: \n[path]: \n[lang]: \n[symbol]:  ()\n\n[code]:\n"
