import random

from pyspark.sql import functions as F

from tesserine.operators import filtering, ordered, packs

SCHEMA = "g string, k int, v int"


def made(n=600, hot=0.4, seed=1):
    """Rows of many groups, one of them with a large share, nulls among groups and values."""
    r = random.Random(seed)
    return [("hot" if r.random() < hot else r.choice([None, "a", "b", *map(str, range(30))]), k, r.choice([None, 0, 1, 5, 9])) for k in range(n)]


def by_group(rows):
    groups = {}
    for g, k, v in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append((k, v))
    return groups


def test_running_sums_and_numbers(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = {r.k: (r.before, r.n) for r in ordered.running(df, ["g"], ["k"], {"before": F.col("v"), "n": F.lit(1)}).collect()}
    want = {}
    for members in by_group(rows).values():
        for i, (k, _) in enumerate(members):
            seen = [v for _, v in members[:i] if v is not None]
            want[k] = (sum(seen) if seen else None, i or None)
    assert got == want
    assert {r.k: r.place for r in ordered.numbered(df, ["g"], [F.desc("k")], "place").collect()} == {k: len(m) - i for m in by_group(rows).values() for i, (k, _) in enumerate(m)}


def test_a_hot_group_spans_parts(spark):
    df = spark.range(4000).select(F.lit("hot").alias("g"), F.col("id").cast("int").alias("k"))
    parts = ordered.in_parts(df, ["g"], ["k"]).groupBy(ordered.PART).count().collect()
    assert len(parts) == 4 and max(p["count"] for p in parts) < 2000


def test_limits_keep_what_a_window_keeps(spark):
    rows = [(g, k, v or 0) for g, k, v in made(seed=2)]
    df = spark.createDataFrame(rows, SCHEMA)
    groups = by_group(rows)
    excerpt = {k for m in groups.values() for i, (k, _) in enumerate(m) if sum(v for _, v in m[:i]) <= 40}
    budget = {k for m in groups.values() for i, (k, _) in enumerate(m) if sum(v for _, v in m[: i + 1]) <= 40}
    assert {r.k for r in packs.excerpts(df, "g", ["k"], F.col("v"), 40).collect()} == excerpt
    assert {r.k for r in packs.budgeted(df, "g", ["k"], F.col("v"), 40).collect()} == budget


def test_blocks_without_size(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 3), ("a", 3, None), ("a", 4, 9)], SCHEMA)
    assert {r.k for r in packs.budgeted(df, "g", ["k"], F.col("v"), 10).collect()} == {2, 3}
    assert {r.k for r in packs.excerpts(df, "g", ["k"], F.col("v"), 2).collect()} == {1, 2}


def test_neighbours_across_parts(spark):
    rows = made(seed=3)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("prev_id", F.lit("replaced"))
    want = {}
    for members in by_group(rows).values():
        keys = [None, *[k for k, _ in members], None]
        want |= {k: (keys[i], keys[i + 2]) for i, k in enumerate(keys[1:-1])}
    assert {r.k: (r.prev_id, r.next_id) for r in packs.neighbours(df, "g", "k", ["k"]).collect()} == want


def test_signatures_before(spark):
    r = random.Random(4)
    rows = [("hot" if i % 3 else None, i, f"func (s *T{i}) M{i}() {{" if r.random() < 0.3 else r.choice(["x", None])) for i in range(300)]
    got = {x.k: x.method for x in packs.enclosing_signature(spark.createDataFrame(rows, "g string, k int, text string"), "g", ["k"]).select("k", "enclosing.method").collect()}
    for g in ("hot", None):
        members = [(k, t) for h, k, t in rows if h == g]
        for i, (k, _) in enumerate(members):
            names = [f"M{j}" for j, t in members[max(0, i - 2) : i] if t and t.startswith("func")]
            assert got[k] == (names[0] if names else None)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ordered.numbered(empty, ["g"], ["k"], "n").count() == packs.neighbours(empty, "g", "k", ["k"]).count() == packs.excerpts(empty, "g", ["k"], F.col("v"), 1).count() == 0
    assert filtering.guarded(spark.createDataFrame([], "q string, id int, retriever_score double, filter_score int"), "q", "id").count() == 0


def test_guarded_of_many_queries(spark):
    r = random.Random(5)
    rows = [(r.choice([None, "big", "big", "big", "low", "same"]), i, round(r.random(), 3), 0) for i in range(500)]
    rows = [(q, i, s, {"low": r.choice([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 3]), "same": 2}.get(q, r.randint(0, 4))) for q, i, s, _ in rows]
    got = {}
    for x in filtering.guarded(spark.createDataFrame(rows, "q string, id int, retriever_score double, filter_score int"), "q", "id").collect():
        got.setdefault(x.q, []).append((x["rank"], x.id, x.lane))
    for q in (None, "big", "low", "same"):
        mine = [(i, s, f) for p, i, s, f in rows if p == q]
        scores = [f for *_, f in mine]
        mean = sum(scores) / len(scores)
        spread = (sum((f - mean) ** 2 for f in scores) / (len(scores) - 1)) ** 0.5
        level = next((t for t in (3, 2, 1) if sum(f >= t for f in scores) >= 8), None)
        if spread < 0.15:
            kept, lane = [(s, i) for i, s, _ in mine], "guard"
        elif level:
            kept, lane = [(round(s + 0.3 * f / 4, 6), i) for i, s, f in mine if f >= level], f"at_{level}"
        else:
            kept, lane = [(round(s + 0.3 * f / 4, 6), i) for i, s, f in sorted(mine, key=lambda m: (-m[1], m[0]))[:16]], "retriever"
        kept.sort(key=lambda x: (-x[0], x[1]))
        assert sorted(got[q]) == [(n + 1, i, lane) for n, (_, i) in enumerate(kept)]


def test_fallback_scores(spark):
    got = {x.k: x.score for x in filtering.fallback_scores(spark.createDataFrame([("a", k, 0) for k in range(8)] + [(None, 9, 0)], SCHEMA), "g", ["k"]).collect()}
    assert got == {**{k: round(1 - k / 8, 9) for k in range(8)}, 9: 1.0}
