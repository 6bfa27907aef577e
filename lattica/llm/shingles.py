"""Word shingles of whole texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

from lattica.llm.common import normalised_words

WIDTH = 5
#: Words whose hash one worker keeps, about 40 MB.
MAX_WORDS = 200_000


class WordHashes(dict):
    def __missing__(self, word: bytes) -> bytes:
        made = blake2b(word, digest_size=8).digest()
        if len(self) < MAX_WORDS:
            self[word] = made
        return made


_hashes = WordHashes()
_FACTORS = np.array([0x9E3779B97F4A7C15 ** (2 * i + 1) % (1 << 64) for i in range(16)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Multiply and shift until every bit depends on all."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Distinct shingles of ``width`` words, sorted; all words as one shingle if there are fewer; none without words."""
    words = normalised_words(text)
    if not words:
        return np.empty(0, np.uint64)
    each = np.frombuffer(b"".join(map(_hashes.__getitem__, words)), "<u8")
    n = min(width, len(each))
    total = np.full(len(each) - n + 1, n, np.uint64)
    for i in range(n):
        total = total + each[i : len(each) - n + 1 + i] * _FACTORS[i]
    return np.unique(mixed(total))


def fingerprint(own: np.ndarray) -> bytes | None:
    """128 bits of the whole set; none for the empty one."""
    return blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def unite(near: np.ndarray) -> np.ndarray:
    """The first member of each row's component in a symmetric boolean matrix."""
    n = len(near)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] >= 0:
            continue
        front = np.zeros(n, bool)
        front[i] = True
        while front.any():
            label[front] = i
            front = near[front].any(0) & (label < 0)
    return label
