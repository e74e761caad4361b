"""Words and shingle hashes of whole texts, for tasks that work on Arrow batches."""

from __future__ import annotations

import numpy as np
import xxhash


def words(text: str | None) -> list[bytes]:
    """Runs of ``[^\\x20\\x09-\\x0D]`` with A-Z lower-cased, as UTF-8.

    bytes.lower and bytes.split know ASCII only, which is exactly this rule.
    """
    return (text or "").encode().lower().split()


class WordHashes(dict):
    """word -> 64-bit hash, remembered for the task; forgotten when it grows past ``most`` words."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; a shorter text is one shingle."""
    if not len(hashes):
        return hashes
    size = min(size, len(hashes))
    n = len(hashes) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = (out ^ hashes[k : k + n]) * _STEP
        out ^= out >> np.uint64(29)
    if size > 1:
        out += np.uint64(size)
    return np.unique(out)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if not len(a) or not len(b):
        return 0
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))
