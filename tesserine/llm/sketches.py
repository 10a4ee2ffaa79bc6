"""SetSketch registers (Ertl 2021): exponentially spaced truncated minima of a set of hashes.

Register i holds ``floor(1 - log_base(h))``, truncated to 0 .. 65535, where h is the least of
exponentially distributed values given to the elements. The larger of two registers is the
register of the union, so sketches merge; two registers agree with a probability that grows
with the sets' Jaccard similarity, so bands of registers find similar sets; and the numbers of
registers that are larger, smaller and equal estimate the similarity by maximum likelihood.
"""

from __future__ import annotations

import numpy as np

from tesserine.llm.words import splitmix

BASE, RATE, LAST = 1.001, 20.0, 65535
_BLOCK = 256


def registers(elements: np.ndarray, m: int) -> np.ndarray:
    """m 16-bit registers of a nonempty set of mixed 64-bit hashes."""
    factors = splitmix(m, 5) | np.uint64(1)
    least = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(elements), _BLOCK):
            np.minimum(least, np.multiply.outer(elements[at : at + _BLOCK], factors).min(axis=0), out=least)
    uniform = (least.astype(np.float64) + 0.5) / 2.0**64
    exponential = -np.log1p(-np.minimum(uniform, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, LAST).astype("<u2")


def enough_equal(m: int, similarity: float) -> int:
    """Equal registers that a pair at the similarity falls short of by chance less than once in 3 million times."""
    return int(m * similarity - 5 * np.sqrt(m * similarity * (1 - similarity)))


def may_reach(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float, slack: float = 13.0) -> np.ndarray:
    """Whether row pairs of registers may have the Jaccard similarity.

    A pair is dropped where the joint likelihood of the register order, given both set sizes,
    is e**slack times larger at a lower similarity than at any allowed one. slack 13 is about
    five standard deviations.
    """
    size_a, size_b = size_a.astype(float), size_b.astype(float)
    m = a.shape[1]
    more, fewer = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    best_all, best_ok = np.full(len(u), -np.inf), np.full(len(u), -np.inf)
    spread = (BASE - 1) / BASE
    at_least = lambda x: np.maximum(x, 1e-12)
    for j in np.linspace(0, 1, 101):
        jj = np.minimum(j, top)
        p = -np.log1p(-spread * at_least(u - v * jj)) / np.log(BASE)
        q = -np.log1p(-spread * at_least(v - u * jj)) / np.log(BASE)
        like = more * np.log(at_least(p)) + fewer * np.log(at_least(q)) + (m - more - fewer) * np.log(at_least(1 - p - q))
        best_all = np.maximum(best_all, like)
        best_ok = np.where(j >= similarity - 0.005, np.maximum(best_ok, like), best_ok)
    return (top >= similarity - 1e-9) & (best_ok >= best_all - slack)
