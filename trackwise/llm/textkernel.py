"""Vectorised text kernels shared by the corpus operators.

Words become 64-bit fingerprints once per batch; shingles, windows and sliding
minima are then plain numpy over the concatenated word array, so the cost per
word is a dictionary look-up and a few vector operations.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: A-Z to a-z on UTF-8 bytes; bytes above 0x7F belong to longer code points and stay.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: as LOWER, and every ASCII character that is neither a digit nor a letter becomes a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32
    for c in range(256)
)

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def blank_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` (what bytes.split() cuts at), null giving none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(LOWER) if lower else raw).split()


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, null giving none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM).split() if text else []


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads every input bit."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """word -> 64-bit fingerprint; emptied when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct fingerprints of the k-word shingles, sorted; fewer words than k make one shingle."""
    n = len(words)
    if n == 0:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            acc = np.uint64(n)
            for w in words:
                acc = mix(np.array([acc], np.uint64))[0] + w
            return mix(np.array([acc], np.uint64))
        acc = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            acc = mix(acc) + words[j : n - k + 1 + j]
        return np.unique(mix(acc))


class WordLanes(dict):
    """word -> row of two tables with the halves of its 128-bit fingerprint; emptied between calls when it holds ``limit`` words."""

    def __init__(self, limit: int = 150_000):
        super().__init__()
        self.limit, self.lanes = limit, np.empty((2, 4096), np.uint64)

    def __missing__(self, word: bytes) -> int:
        row = len(self)
        if row == self.lanes.shape[1]:
            self.lanes = np.concatenate([self.lanes, np.empty_like(self.lanes)], axis=1)
        high, low = divmod(xxhash.xxh3_128_intdigest(word), 1 << 64)
        self.lanes[:, row] = high, low
        self[word] = row
        return row

    def of(self, words: list[bytes]) -> np.ndarray:
        """2 x n fingerprints."""
        if len(self) > self.limit:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.lanes[:, rows]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of two sequences' hashes, the hash of one after the other."""
    x = a * _M1
    x += b
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


def sequence_hashes(words: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length (ascending), hashes of that many consecutive words, along the last axis.

    Hashes of 1, 2, 4 ... words are joined from two halves, and others from two that overlap. No step is linear in the
    words, so patterns of repeated words can't cancel out as in a polynomial.
    """
    out, have, x = [], 1, words
    with np.errstate(over="ignore"):
        for k in lengths:
            while have * 2 <= k:
                x = _joined(x[..., :-have], x[..., have:])
                have *= 2
            rest = k - have
            out.append(_joined(x[..., : x.shape[-1] - rest], x[..., rest:]) if rest and x.shape[-1] else x)
    return out


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values, by doubling."""
    have = 1
    while have * 2 <= w:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (w - have)], x[w - have :]) if w > have else x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
