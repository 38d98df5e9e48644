"""Word-shingle sets of texts as 64-bit hashes, computed batch by batch inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

_STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of a word, remembered; emptied when it grows, so memory stays bounded."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, n: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the runs of `n` words of the text, A-Z in lower case.

    A text with fewer words has one shingle, all of its words; one without words has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        total = total * _STEP + hashed[i : len(words) - n + 1 + i]
    return np.unique(_mixed(total))


def set_id(shingles: np.ndarray) -> int:
    """Signed 64-bit digest of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes(), 7)).astype(np.int64))


class MinHash:
    """Signature of a set: the least value of each of `size` hash functions, as 32-bit integers."""

    BLOCK = 256

    def __init__(self, size: int):
        random = np.random.default_rng(20240607)
        self.factors = random.integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = random.integers(0, 2**63, size, dtype=np.uint64)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factors), 2**32 - 1, np.uint64)
        for i in range(0, len(shingles), self.BLOCK):
            part = shingles[i : i + self.BLOCK, None] * self.factors + self.shifts
            np.minimum(least, (part >> np.uint64(32)).min(axis=0), out=least)
        return least.astype(np.uint32).view(np.int32)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a ∩ b| >= percent * |a ∪ b|."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return bool(common) and 100 * common >= percent * (len(a) + len(b) - common)
