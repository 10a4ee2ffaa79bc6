"""The M-tree against brute force: ties, repeated ids, ragged vectors, many blocks and trees; and what its bounds save."""

import numpy as np

from tesserine.llm import mtree


def table(spark, data, extra="rank string, score string"):
    return spark.createDataFrame([(i, None if v is None else [int(x) for x in v], "x", "x") for i, v in data], f"vec_id long, vector array<long>, {extra}")


def brute(data, queries, k=10):
    usable = [(i, np.array([*v, *[0] * (8 - len(v))])) for i, v in data if i is not None and v is not None]
    out = {}
    for q in queries:
        own = np.array(min((list(v) for i, v in usable if i == q)))
        best = sorted((-int(v @ own), i) for i, v in usable if i != q)[:k]
        out[q] = [(r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def test_blocks_and_trees(spark):
    rnd = np.random.default_rng(4)
    data = [(i, rnd.integers(-50, 50, 8)) for i in range(700)] + [(i, [7] * 8) for i in range(700, 800)] + [(3, [1] * 8), (3, [9] * 8), (900, [4, 4]), (901, []), (None, [99] * 8), (902, None)]
    got = mtree.top_k(table(spark, data).repartition(3), table(spark, [d for d in data if d[0] is not None and d[0] % 20 in (0, 3)]), tree_rows=90, page=6, block=7).collect()
    want = brute(data, sorted({i for i, v in data if i is not None and v is not None and i % 20 in (0, 3)}))
    assert {q: sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) for q in want} == want and len(got) == 10 * len(want)


def test_bounds_save_distances(spark):
    """On clustered vectors far fewer distances than rows are computed, and the result is the same."""
    rnd = np.random.default_rng(6)
    centres = rnd.integers(-1000, 1000, (40, 8))
    data = [(i, centres[i % 40] + rnd.integers(-8, 8, 8)) for i in range(4000)]
    vectors = table(spark, data)
    got = mtree.top_k(vectors, vectors.where("vec_id < 40"), tree_rows=2000, page=16, counted=True).collect()
    want = brute(data, range(40))
    assert {q: sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q) for q in want} == want
    computed = {r.query_id: r.computed for r in got}
    assert len(computed) == 40 and sum(computed.values()) / 40 < 2000, "less than half of 4000 rows"
