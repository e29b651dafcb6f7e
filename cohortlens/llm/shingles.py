"""Word shingles as 64-bit hashes, computed batch by batch in numpy.

Words are those of UTF-8 text with A-Z lower-cased. A shingle hash mixes the hashes of its words in order; two shingles of
one pair of texts collide with a chance of about 2**-64 each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_C = np.uint64(0x9E3779B97F4A7C15)
_D = np.uint64(0xBF58476D1CE4E5B9)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _D
    return x ^ (x >> np.uint64(29))


class WordHashes(dict):
    """Hash of a word, remembered; emptied by `trim` when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def trim(self, most: int = 500_000) -> None:
        if len(self) > most:
            self.clear()


class Shingler:
    """Distinct shingles of texts: sorted uint64 arrays. A text of fewer than `width` words is one shingle, of none empty."""

    def __init__(self, width: int):
        self.width, self.words = width, WordHashes()

    def hashes(self, text: bytes) -> np.ndarray:
        words = text.lower().split()
        return np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))

    def distinct(self, text: bytes) -> np.ndarray:
        h = self.hashes(text)
        if not len(h):
            return h
        width = min(self.width, len(h))
        x = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            x = mix(x * _C + h[i:len(h) - width + 1 + i])
        return np.unique(x)

    def each(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        for text in texts:
            yield self.distinct(text)
        self.words.trim()


def fingerprint(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a set."""
    return xxhash.xxh64_intdigest(shingles.tobytes()) - (1 << 63)
