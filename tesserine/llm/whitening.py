"""Embedding whitening by a residue-number scatter.

Entries become integers. Each task multiplies its vectors, reduced modulo several primes, by
their transpose in double-precision matrix products that are exact: residues lie within half a
prime of 0 and so few rows are multiplied at once that no sum leaves the exact integers of a
double. The residues are added up by prime and cell, and Chinese remaindering gives the exact
sums of products, from which n * n * covariance follows in integers. Only then it is rounded, and
a symmetric eigendecomposition in double precision gives the components.

A constant 1 is appended to each vector, so the same products give the sums and the count.
The driver gets one number a prime and cell, whatever the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserine.llm import shared

#: Primes lie below this power of two.
PRIME_BITS = 21
#: Rows of one exact product: ROWS * (2**(PRIME_BITS - 1))**2 <= 2**53.
ROWS = 1 << (53 - 2 * (PRIME_BITS - 1))


def integers(embedding: Column, scale: float = 64.0, offset: int = 1_000_000) -> Column:
    """floor(scale * c) + offset of each entry c as long; null for vectors that are null or empty, or hold null, non-finite or, scaled, too large entries (2**62)."""
    far = F.lit(float(1 << 62))
    odd = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double") * F.lit(scale)) >= far))
    return F.when((F.size(embedding) > 0) & ~odd, F.transform(embedding, lambda c: F.floor(c.cast("double") * F.lit(scale)) + F.lit(offset).cast("long")))


def primes(bound: int) -> list[int]:
    """The largest primes below 2**PRIME_BITS whose product exceeds ``bound``."""
    found, product, candidate = [], 1, (1 << PRIME_BITS) - 1
    while product <= bound:
        if all(candidate % q for q in range(3, int(candidate**0.5) + 1, 2)):
            found.append(candidate)
            product *= candidate
        candidate -= 2
    return found


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def residues(vectors: np.ndarray, prime: int) -> np.ndarray:
    """The sum over rows of the outer products of (vector, 1), modulo the prime."""
    d = vectors.shape[1] + 1
    out = np.zeros((d, d), np.int64)
    for at in range(0, len(vectors), ROWS):
        part = vectors[at : at + ROWS] % prime
        part = np.where(part > prime // 2, part - prime, part).astype(np.float64)
        part = np.column_stack([part, np.ones(len(part))])
        out = (out + (part.T @ part).astype(np.int64)) % prime
    return out


def reconstruct(remainders: list[int], moduli: list[int]) -> int:
    """The integer of least magnitude with these remainders."""
    value, product = 0, 1
    for r, p in zip(remainders, moduli, strict=True):
        value += product * ((r - value) * pow(product, -1, p) % p)
        product *= p
    return value - product if 2 * value > product else value


@dataclass
class Fit:
    """Count, exact sums, and components (rows) with their eigenvalues and shares of the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray


def scatter(vectors: DataFrame, dim: int, bound: int) -> tuple[int, list[int], list[list[int]]]:
    """(count, sums, sums of products) of ``vectors`` (column x), exact; ``bound`` is at least every sum's magnitude."""
    moduli = primes(2 * bound + 1)
    upper = np.triu_indices(dim + 1)

    def run(batches):
        total = [np.zeros((dim + 1, dim + 1), np.int64) for _ in moduli]
        for batch in batches:
            x = _matrix(batch.column("x"))
            for k, p in enumerate(moduli):
                total[k] = (total[k] + residues(x, p)) % p
        cells = np.arange(len(upper[0]))
        for k in range(len(moduli)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), k), pa.int32()), pa.array(cells, pa.int32()), pa.array(total[k][upper], pa.int64())], ["prime", "cell", "residue"])

    rows = vectors.select("x").mapInArrow(shared.trimmed(run), "prime int, cell int, residue long").groupBy("prime", "cell").agg(F.sum("residue").alias("residue")).collect()
    table = np.zeros((len(upper[0]), len(moduli)), np.int64)
    for r in rows:
        table[r.cell, r.prime] = r.residue % moduli[r.prime]
    exact = [[0] * (dim + 1) for _ in range(dim + 1)]
    for i, j, found in zip(*(u.tolist() for u in upper), table.tolist(), strict=True):
        exact[i][j] = exact[j][i] = reconstruct(found, moduli)
    return exact[dim][dim], exact[dim][:dim], [row[:dim] for row in exact[:dim]]


def fit(vectors: DataFrame, dim: int, n: int, largest: int, components: int = 32) -> Fit:
    """Whitening fitted on all ``vectors`` (column x of ``dim`` longs, n rows, entries of magnitude up to ``largest``)."""
    count, sums, products = scatter(vectors, dim, n * max(1, largest) ** 2)
    if count != n:
        raise RuntimeError(f"the input changed while it was read: {count} rows, then {n}")
    centred = [[n * products[i][j] - sums[i] * sums[j] for j in range(dim)] for i in range(dim)]
    covariance = np.array([[c / (n * n) for c in row] for row in centred])
    values, vectors_ = np.linalg.eigh(covariance)
    keep = np.arange(dim)[::-1][: min(components, dim)]
    trace = sum(centred[i][i] for i in range(dim)) / (n * n)
    values = np.where(values > dim * np.finfo(float).eps * max(values.max(), 0), values, 0.0)[keep]
    return Fit(n, sums, np.ascontiguousarray(vectors_.T[keep]), values, values / trace if trace else np.zeros(len(keep)))


def numerators(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: int64 where it fits, else Python integers."""
    if n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums)) < 1 << 63:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(top: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; None where it leaves the 64-bit integers."""
    most = max(abs(int(top.max(initial=0))), abs(int(top.min(initial=0))))
    if most * most * top.shape[1] < 1 << 63:
        return (top * top).sum(axis=1).tolist()
    exact = [sum(v * v for v in row) for row in top.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def _whitened(top: np.ndarray, model: Fit) -> np.ndarray:
    """One column a component; 0 for components without variance."""
    scale = np.where(model.values > 0, 1 / np.sqrt(np.where(model.values > 0, model.values, 1)), 0)
    return (top.astype(np.float64) / model.n) @ model.components.T * scale


def identity_error(vectors: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the covariance of the whitened vectors, measured over all rows, minus the identity. Components without variance are left out."""
    live = np.flatnonzero(model.values > 0)
    k = len(live)
    upper = np.triu_indices(k + 1)

    def run(batches):
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _whitened(numerators(_matrix(batch.column("x")), model.n, model.sums), model)[:, live]
            w = np.column_stack([w, np.ones(len(w))])
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0])), pa.int32()), pa.array(total[upper])], ["cell", "value"])

    rows = vectors.select("x").mapInArrow(shared.trimmed(run), "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()
    total = np.zeros((k + 1, k + 1))
    for r in rows:
        total[upper[0][r.cell], upper[1][r.cell]] = total[upper[1][r.cell], upper[0][r.cell]] = r.value
    mean = total[k, :k] / model.n
    return float(np.abs(total[:k, :k] / model.n - np.outer(mean, mean) - np.eye(k)).max(initial=0))


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each vector and component.

    vectors: vec_id and x, an array of longs as ``integers`` makes it; other columns are left
    out. Rows whose x is null or holds null take no part, nor do vectors of another length than
    the most frequent one (ties: the longest). n rows are left; deviation is the exact sum of
    (n * x - sums)**2, null where it leaves the 64-bit integers. Components are numbered from 1
    by falling eigenvalue. One without variance (constant or too few vectors) has whitened null
    and explained 0, and identity_error leaves it out. Equal eigenvalues leave their components
    free to turn among themselves. Null and repeated vec_ids are rows like others. An empty
    table gives no rows. The driver holds arrays of the square of the dimension.
    """
    spark = vectors.sparkSession
    shared.bounded_batches(spark)
    rows = shared.pick(vectors, "vec_id", "x").where("x IS NOT NULL AND size(x) > 0 AND NOT exists(x, c -> c IS NULL)")
    most = F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("largest")
    head = rows.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"), most).orderBy(F.desc("n"), F.desc("dim")).first()
    kind = vectors.schema["vec_id"].dataType.simpleString()
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if head is None:
        return rows.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in zip(names[1:], ("int", "long", "long", "double", "double", "double"), strict=True)])
    rows = rows.where(F.size("x") == head.dim)
    model = fit(rows, head.dim, head.n, head.largest, components)
    error = identity_error(rows, model)
    k = len(model.values)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                top = numerators(_matrix(part.column("x")), model.n, model.sums)
                m = len(part)
                spread = pa.array(np.repeat(np.arange(m), k))
                dead = np.tile(model.values <= 0, m)
                columns = [part.column("vec_id").take(spread), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, model.n), pa.int64()), pa.array(deviations(top), pa.int64()).take(spread)]
                columns += [pa.array(_whitened(top, model).ravel(), mask=dead), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(shared.trimmed(run), schema)
