"""Array work on UTF-8 bytes: words, substring hashes and padded walks over documents."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to ``n``."""
    if not _powers or len(_powers[0]) <= n:
        out = []
        for base in (BASE, INVERSE):
            p = np.full(n + 1, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if n > 1 << 23:  # too large to keep
            return out[0], out[1]
        _powers[:] = out
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes, in place."""
    for shift, factor in ((np.uint64(30), 0xBF58476D1CE4E5B9), (np.uint64(27), 0x94D049BB133111EB)):
        h ^= h >> shift
        h *= np.uint64(factor)
    h ^= h >> np.uint64(31)
    return h


class Hasher:
    """Hashes of any substrings of one byte array, equal for equal content."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true values."""
    edge = np.diff(np.concatenate([[0], member.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def python_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


class Padded:
    """Walks over documents of several lengths at once.

    Documents are ordered by falling length, so that those with an element at step t are a
    prefix; ``rows[t]`` are the flat element numbers of that prefix at step t.
    """

    def __init__(self, counts: np.ndarray):
        self.order = np.argsort(-counts, kind="stable")
        self.counts = counts[self.order]
        firsts = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
        self.first = firsts[self.order].astype(np.int64)
        self.steps = int(self.counts[0]) if len(counts) else 0
        self.active = np.searchsorted(-self.counts, -np.arange(self.steps), "left")

    def at(self, t: int) -> tuple[int, np.ndarray]:
        n = int(self.active[t])
        return n, self.first[:n] + t
