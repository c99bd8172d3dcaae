"""Word arrays of texts for the Python side of the operators.

Words are what lies between the white space characters U+0020 and U+0009 to U+000D.
`bytes.split` and `bytes.lower` know exactly these and A to Z, whatever the text holds.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Entries of a worker's word cache; past it, words are hashed anew each time.
CACHE = 250_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class WordHashes(dict):
    """64-bit hash of each word, remembered for the first CACHE different ones."""

    def __missing__(self, word):
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE:
            self[word] = value
        return value

    def of(self, words) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def lower_words(text: str | None) -> list[bytes]:
    """Words with A to Z in lower case; no text has no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def scramble(x: np.ndarray) -> np.ndarray:
    """Finishing mix of 64-bit values, so that every bit depends on every other."""
    x = x ^ (x >> np.uint64(32))
    x = x * MIX[0]
    x = x ^ (x >> np.uint64(29))
    x = x * MIX[1]
    return x ^ (x >> np.uint64(32))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """One hash per window of n words, in order; fewer words give one window of all."""
    if not len(words):
        return words
    n = min(n, len(words))
    total = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        total = scramble(total + words[i : len(words) - n + 1 + i])
    return total


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted different window hashes."""
    return np.unique(gram_hashes(words, n))
