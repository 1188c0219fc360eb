"""Words and shingles of one text as arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xBF58476D1CE4E5B9)
_KEPT_WORDS = 400_000


class WordHashes(dict):
    """Hashes of the words seen so far; emptied when it has grown past its bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def lower_words(text: str) -> list[bytes]:
    """A-Z lower-cased, parted at white space of ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def hashes_of(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _STEP
    return values ^ (values >> np.uint64(31))


def shingle_set(words: np.ndarray, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of ``size`` words; of fewer words, the whole sequence as one."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    run = words[:n - size + 1] + np.uint64(size)
    for i in range(1, size):
        run = _mixed(run * _FACTOR + words[i:n - size + 1 + i])
    return np.unique(_mixed(run))
