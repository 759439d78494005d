"""Word and shingle hashing in numpy, the same in every process."""

from __future__ import annotations

import numpy as np
import xxhash

U64 = np.uint64
#: Odd multipliers for combining word hashes by position, and the finaliser's (any odd values do).
STEP = U64(0x9E3779B97F4A7C15)
MIX1, MIX2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


class WordHashes(dict):
    """64-bit hash of each word seen; forgets them all when it has grown to its limit."""

    def __init__(self, limit: int = 500_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit moves every output bit."""
    x = (x ^ (x >> U64(30))) * MIX1
    x = (x ^ (x >> U64(27))) * MIX2
    return x ^ (x >> U64(31))


def split_words(data: bytes) -> list[bytes]:
    """Lower-case A-Z, then maximal runs outside [\\x20\\x09-\\x0D]: what bytes.lower and bytes.split do."""
    return data.lower().split()


def shingle_set(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of width words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, U64)
    span = min(width, n)
    out = hashes[: n - span + 1].copy()
    for j in range(1, span):
        out *= STEP
        out += hashes[j : n - span + 1 + j]
    return np.unique(mix(out + U64(span)))
