"""Word fingerprints and shingle sets, computed with numpy on whole texts inside Spark tasks.

Words are split on the ASCII white space bytes 0x20 and 0x09-0x0D, and A-Z is lower-cased, so no
Unicode table is involved. Texts are worked on in batches of about a megabyte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_TABLE = np.random.Generator(np.random.PCG64(20260101)).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TABLE[65:91] = _TABLE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX1
        x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def word_hashes(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of the bytes ``a`` starts, and its 64-bit hash."""
    inside = np.concatenate(([False], _INSIDE[a], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, np.empty(0, np.uint64)
    lengths = end - start
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(lengths.max()) + 1, _BASE))
        place = np.arange(len(a), dtype=np.int64)
        place -= np.repeat(start, np.diff(np.append(start, len(a))))[: len(a) - start[0]] if start[0] == 0 else np.concatenate((np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(a))))))
        values = _TABLE[a] * powers[np.minimum(np.maximum(place, 0), len(powers) - 1)]
        values *= inside[1:-1]
        return start, mix(np.add.reduceat(values, start) + lengths.astype(np.uint64))


def batches(texts: list[bytes], size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``size`` bytes together."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t) + 1
        if total >= size:
            yield first, i + 1
            first, total = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles.

    A text of fewer words is one shingle; a text without words has none.
    """
    for i, j in batches(texts):
        part = texts[i:j]
        a = np.frombuffer(b"\n".join(part), np.uint8)
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        start, w = word_hashes(a)
        first = np.searchsorted(start, begin)
        with np.errstate(over="ignore"):
            h = np.full(max(len(w) - k + 1, 0), np.uint64(k))
            for s in range(k):
                h = mix(h * _BASE + w[s : len(w) - k + 1 + s])
            for x, y in zip(first[:-1], first[1:], strict=True):
                if y - x >= k:
                    own = np.sort(h[x : y - k + 1])
                    yield own[np.concatenate(([True], own[1:] != own[:-1]))]
                else:
                    one = np.full(min(1, y - x), np.uint64(y - x))
                    for s in range(y - x):
                        one = mix(one * _BASE + w[x + s : x + s + 1])
                    yield one
