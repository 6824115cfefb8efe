"""Word shingles of texts as 64-bit hashes."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from netspark.llm.workers import worker_state

WORD = re.compile(r"\w+")
#: Words whose hash a worker remembers.
CACHE_WORDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


class WordHashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return value


def word_hashes() -> WordHashes:
    return worker_state("words", WordHashes)


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    values = (values ^ (values >> np.uint64(32))) * _MIX
    values = (values ^ (values >> np.uint64(29))) * _MIX
    return values ^ (values >> np.uint64(32))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` neighbours, by a polynomial over their hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, width):
        total *= _STEP
        total += hashes[k : k + n]
    return mixed(total)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct shingles of ``width`` lower-case words; a shorter text with words is one shingle."""
    words = WORD.findall(text.lower()) if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.array(list(map(word_hashes().__getitem__, words)), np.uint64)
    return np.unique(windows(hashes, min(width, len(words))))
