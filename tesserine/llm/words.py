"""Words, word hashes and n-gram hashes of Arrow string columns, computed on the UTF-8 bytes.

A word is a run of bytes other than ``\x20`` and ``\x09-\x0D``. All functions work on whole
batches with numpy; ``pieces`` bounds the memory by cutting a batch at document boundaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A word longer than this is hashed by itself.
LONG_WORD = 1 << 14
PIECE_BYTES = 4 << 20


def splitmix(n: int, seed: int) -> np.ndarray:
    """n well mixed 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of MurmurHash3."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


_BYTE = splitmix(256, 11) | np.uint64(1)
_BYTE[SPACE] = 0
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(LONG_WORD + 1, 0x9E3779B97F4A7C15 | 1, np.uint64))
_PLACE = splitmix(64, 77) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(texts: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes each, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield at, to
        at = to


class Words:
    """Words of a string array. ``bounds[d]:bounds[d + 1]`` are the words of row d."""

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts, "").cast(pa.large_binary())
        _, offsets, data = texts.buffers()
        off = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        self.offsets = off - off[0]
        inside = ~SPACE[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = self.offsets[1:] > self.offsets[:-1]
        before[self.offsets[:-1][full]] = False
        after[self.offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + (1 << 20), "right")))
            a, b = self.starts[at], self.ends[to - 1]
            if b - a > 1 << 21:  # one very long word
                out[at] = xxhash.xxh3_64_intdigest(self.data[a:b].tobytes())
            else:
                starts = self.starts[at:to] - a
                place = np.arange(b - a) - np.repeat(starts, np.diff(np.append(starts, b - a)))
                with np.errstate(over="ignore"):
                    out[at:to] = np.add.reduceat(_BYTE[self.data[a:b]] * _POWER[np.minimum(place, LONG_WORD)], starts)
                for i in np.flatnonzero(self.ends[at:to] - self.starts[at:to] > LONG_WORD) + at:
                    out[i] = xxhash.xxh3_64_intdigest(self.data[self.starts[i] : self.ends[i]].tobytes())
            at = to
        return mix(out)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, document borders ignored: entry i covers words i to i + n - 1."""
    count = max(0, len(hashes) - n + 1)
    out = np.zeros(count, np.uint64)
    with np.errstate(over="ignore"):
        for t in range(n):
            out += hashes[t : t + count] * _PLACE[t]
        return mix(out + np.uint64(n))
