"""Words of texts as hashes, for operators on word sequences and shingles."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORD = re.compile(r"\w+")
#: Words whose hash a task remembers, about 200 bytes each.
KNOWN_WORDS = 100_000


class WordHashes(dict):
    """64-bit hashes of words; forgets all when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def text_words(text: str | None) -> list[str]:
    """Lower-case runs of letters, digits and underscores."""
    return WORD.findall((text or "").lower())


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed(texts: list[str | None], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts one after another, words per text)."""
    lists = [text_words(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((hashes[w] for words in lists for w in words), np.uint64, int(sizes.sum()))
    return flat, sizes


def shingles(flat: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, shingles per text): every ``width`` words in a row; a shorter text is one shingle."""
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    starts = np.cumsum(sizes) - sizes
    places = np.arange(counts.sum()) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    lasts = np.repeat(starts + sizes, counts)
    out = np.zeros(len(places), np.uint64)
    padded = np.concatenate([flat, np.zeros(width, np.uint64)])
    for k in range(width):
        word = np.where(places + k < lasts, padded[places + k], np.uint64(k))
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + word)
    return out, counts
