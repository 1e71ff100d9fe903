"""Word shingles of whole texts as 64-bit numbers, for batches of texts at a time."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words of a shingle.
SIZE = 5
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WordIds(dict):
    """Hash of each word, kept for words met before."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str, ids: WordIds) -> np.ndarray:
    """Hashes of the lower-cased words of a text in order."""
    return np.array([ids[w] for w in text.lower().split()], np.uint64)


def of_words(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of SIZE words; a shorter text that has words is one shingle, none gives none."""
    if not len(words):
        return words
    size = min(SIZE, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out + words[k : len(words) - size + 1 + k] + np.uint64(k + 1))
    return out
