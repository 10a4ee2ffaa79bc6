"""Whitening against exact rational sums."""

import math

import numpy as np

from tesserine.llm import registry, whitening

F32 = "vec_id long, embedding array<float>, n string"


def rows_of(draw, n, d):
    mix = draw.normal(size=(d, d))
    return [(i, [float(np.float32(v)) for v in row], "x") for i, row in enumerate(draw.normal(size=(n, d)) @ mix)]


def run(spark, tmp_path, rows, schema=F32):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    return registry.op12_whitening(spark, str(tmp_path)).collect()


def test_against_exact_sums(spark, tmp_path):
    rows = rows_of(np.random.default_rng(0), 300, 40)
    bad = [(900, None, "x"), (901, [float("nan")] + [0.0] * 39, "x"), (902, [None] + [0.0] * 39, "x"), (903, [float("inf")] + [0.0] * 39, "x"), (904, [], "x"), (905, [1.0], "x")]
    got = run(spark, tmp_path, rows + bad + [(None, rows[0][1], "x"), rows[1]])
    used = rows + [(None, rows[0][1], "x"), rows[1]]
    x = [[math.floor(64 * v) + 1000000 for v in r[1]] for r in used]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    assert len(got) == n * 32 and {r.n for r in got} == {n}
    top = [[n * v - t for v, t in zip(r, s, strict=True)] for r in x]
    by_id = {r[0]: t for r, t in zip(used, top, strict=True)}
    exact = np.array([[sum(t[i] * t[j] for t in top) / n**3 for j in range(40)] for i in range(40)])
    values, components = np.linalg.eigh(exact)
    values, components = values[::-1], components.T[::-1]
    signs = {}
    for r in got:
        t = by_id[r.vec_id]
        assert r.deviation == sum(v * v for v in t)
        want = float(np.array(t) / n @ components[r.component - 1] / math.sqrt(values[r.component - 1]))
        sign = signs.setdefault(r.component, 1 if want * r.whitened > 0 else -1)
        assert abs(want * sign - r.whitened) < 1e-7
        assert abs(r.explained - values[r.component - 1] / values.sum()) < 1e-9
        assert r.identity_error < 1e-9


def test_no_variance_and_no_rows(spark, tmp_path):
    rows = [(1, [0.5, 1.0, 2.0], "x"), (2, [0.5, 1.0, 4.0], "x"), (3, [0.5, 2.0, 9.0], "x")]
    got = run(spark, tmp_path, rows)
    assert sorted((r.component, r.whitened is None) for r in got) == [(1, False)] * 3 + [(2, False)] * 3 + [(3, True)] * 3
    assert all(r.explained == 0 for r in got if r.component == 3) and got[0].identity_error < 1e-9
    assert [(r.whitened, r.explained) for r in run(spark, tmp_path, [(7, [1.0, 2.0], "x")])] == [(None, 0.0)] * 2
    assert run(spark, tmp_path, []) == [] and run(spark, tmp_path, [(1, None, "x")]) == []


def test_integers_beyond_the_machine(spark, tmp_path):
    """Entries up to 2**61: residues stay exact, deviations that leave 64 bits are null."""
    draw = np.random.default_rng(4)
    rows = [(i, [float(np.float32(v)) for v in draw.normal(size=3) * 2.0**52], "x") for i in range(50)] + [(99, [1e30, 0.0, 0.0], "x")]
    got = run(spark, tmp_path, rows)
    assert len(got) == 150 and got[0].identity_error < 1e-9 and {r.deviation for r in got} == {None}
    x = [[math.floor(64 * v) + 1000000 for v in r[1]] for r in rows[:50]]
    vectors = spark.createDataFrame([(r,) for r in x], "x array<long>").repartition(4)
    n, sums, products = whitening.scatter(vectors, 3, 50 * (1 << 124))
    assert n == 50 and sums == [sum(c) for c in zip(*x, strict=True)]
    assert products == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]


def test_residues_and_reconstruction():
    draw = np.random.default_rng(1)
    x = draw.integers(-(2**62), 2**62, (whitening.ROWS + 100, 3))
    moduli = whitening.primes(2 * len(x) * 2**124)
    assert all(p % q for p in moduli for q in range(2, 1500)) and len(set(moduli)) == len(moduli)
    cells = [whitening.residues(x, p) for p in moduli]
    want = [[sum(a * b for a, b in zip(x[:, i].tolist(), x[:, j].tolist(), strict=True)) for j in range(3)] for i in range(3)]
    assert [[whitening.reconstruct([int(c[i, j]) for c in cells], moduli) for j in range(3)] for i in range(3)] == want
