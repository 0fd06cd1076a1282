"""Text columns as flat numpy arrays of code points: the shared ground of the vectorised operators.

A task gets Arrow batches; `blocks` cuts them into runs of bounded size (a longer text makes a run of its own), so the
memory of a task doesn't depend on how many rows its partition has.
"""

from __future__ import annotations

import numpy as np

BLOCK_CHARS = 1_500_000


def mix64(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit integers (the finaliser known as splitmix64)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: list, limit: int = BLOCK_CHARS):
    """Index ranges of `texts` (strings or None) with at most `limit` code points each, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def flatten(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """All code points in a row (uint32), and the offset of each text, with the end as the last. None counts as empty."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) if t else 0 for t in texts], out=offsets[1:])
    return np.frombuffer("".join(t for t in texts if t).encode("utf-32-le"), np.uint32), offsets


class SpanHash:
    """64-bit hashes of any span of a flat array, from one prefix sum.

    A span s..e has the hash (C[e] - C[s]) * B^-s with C the sums of mix(c_i) * B^i modulo 2^64; equal spans have equal
    hashes wherever they lie. Different spans may have equal ones (there are known words that have, whatever the base), so whoever takes
    equal hashes for equal spans compares the spans afterwards. The table for code points is built once for each process.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    _mixed: np.ndarray | None = None
    _powers: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def tables(cls, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if cls._mixed is None:
            cls._mixed = mix64(np.arange(0x110000))
        if cls._powers is None or len(cls._powers[0]) <= n:
            size = max(n + 1, 1 << 21)
            cls._powers = tuple(
                np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64), dtype=np.uint64)))
                for b in (np.uint64(cls.BASE), np.uint64(pow(cls.BASE, -1, 1 << 64)))
            )
        return cls._mixed, *cls._powers

    def __init__(self, codes: np.ndarray):
        mixed, powers, self.inverse = self.tables(len(codes))
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(mixed[codes] * powers[: len(codes)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def first_difference(codes: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each pair of spans codes[a:a+size] and codes[b:b+size] the first place where they differ; size where they are equal."""
    ends = np.cumsum(sizes)
    out = sizes.copy()
    if len(ends) and ends[-1]:
        inside = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)
        differ = np.flatnonzero(codes[np.repeat(a, sizes) + inside] != codes[np.repeat(b, sizes) + inside])
        pair, first = np.unique(np.searchsorted(ends, differ, "right"), return_index=True)
        out[pair] = inside[differ[first]]
    return out
