"""What Order MinHash is for: texts a few edits apart stay alike, the same words in another order don't."""

import random

from pyspark.sql import functions as F

from tesserine.llm import fingerprints


def test_order_counts(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(40):
        words = [f"w{rnd.randint(0, 5000)}" for _ in range(400)]
        edited = list(words)
        for k in rnd.sample(range(400), 4):
            edited[k] = "edit"
        blocks = [words[k : k + 10] for k in range(0, 400, 10)]
        rnd.shuffle(blocks)  # nine of ten three-word runs stay, in another order
        rows.append((i, " ".join(words), " ".join(edited), " ".join(w for b in blocks for w in b), " ".join(f"o{rnd.randint(0, 5000)}" for _ in range(400))))
    df = spark.createDataFrame(rows, "i int, own string, edited string, moved string, other string")
    for c in ("own", "edited", "moved", "other"):
        df = fingerprints.with_fingerprint(df, c, f"{c}_fp", pool=f"p_{c}")
    near = lambda c: F.avg(fingerprints.likeness(F.col("own_fp"), F.col(f"{c}_fp"))).alias(c)
    row = df.select("own_fp", "edited_fp", "moved_fp", "other_fp").agg(near("edited"), near("moved"), near("other")).first()
    assert row.edited > 0.85 and row.other < 0.05
    assert row.moved < row.edited - 0.25, "runs that only moved must count less than runs that stayed"
