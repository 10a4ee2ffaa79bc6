import random

from tesserine.operators import packs
from tesserine.queries import registry

LEFT, RIGHT = "file int, key int, start_line int, end_line int", "file int, r_key int, r_start int, r_end int"


def test_best_overlap_is_brute_force(spark):
    rnd = random.Random(5)
    span = lambda: (a := rnd.randint(-70, 400), a + rnd.choice([0, 5, 20, 63, 200]))
    left = [(i % 3, i, *span()) for i in range(150)]
    right = [(i % 3, i, *span()) for i in range(120)]
    want = []
    for f, k, a, b in left:
        found = [(min(b, d) - max(a, c) + 1, -r) for g, r, c, d in right if g == f and c <= b and d >= a]
        want += [(f, k, -max(found)[1], max(found)[0])] if found else []
    got = packs.best_overlap(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "file", "key").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_odd_keys_are_ranges_too(spark, tmp_path):
    spark.createDataFrame([(1, 3), (1, 5), (2, 4)], "o_custkey long, o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {(r.file, r.key): r.r_key for r in registry.QUERIES["line_overlap_best"](spark, str(tmp_path)).collect()}
    assert got == {(1, 3): 3, (1, 5): 3, (2, 4): 4}


def test_a_hot_file_pairs_distinct_ranges_only(spark):
    n = 20_000  # 400 million pairs of rows, 25 of ranges
    left = spark.range(n).selectExpr("1 AS file", "CAST(id AS int) AS key", "CAST(id % 5 AS int) AS start_line", "CAST(id % 5 + 9 AS int) AS end_line")
    right = spark.range(n).selectExpr("1 AS file", "CAST(id AS int) AS r_key", "CAST(id % 5 AS int) AS r_start", "CAST(id % 5 + 9 AS int) AS r_end")
    got = packs.best_overlap(left, right, "file", "key").collect()
    assert len(got) == n and all(r.r_key == r.key % 5 and r.overlap == 10 for r in got)
