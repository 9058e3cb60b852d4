"""Words of a text as bytes, their 64-bit hashes, and hashes of five-word shingles, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

SHINGLE = 5
#: Bytes of text that are worked on at once; bounds a task's memory at any batch size.
SLICE_BYTES = 1 << 19
#: Distinct words whose hashes a task remembers.
REMEMBERED = 200_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_32 = np.uint64(32)


class WordHashes(dict):
    """word -> 64-bit hash, remembered for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def space_words(raw: bytes) -> list[bytes]:
    """Runs of bytes other than 20 and 09-0D, after lower-casing A-Z (bytes.lower and split know ASCII alone)."""
    return raw.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _32)) * _MIX
    return (x ^ (x >> _32)) * _ODD


def shingles(h: np.ndarray) -> np.ndarray:
    """A hash for each five consecutive word hashes; of fewer words, one for the whole sequence; of none, none."""
    n = len(h)
    if n == 0:
        return h
    size = min(n, SHINGLE)
    out = h[: n - size + 1].copy()
    for k in range(1, size):
        out *= _ODD
        out += h[k : n - size + 1 + k]
    return mixed(out + np.uint64(size))


def slices(raws: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Index ranges of about SLICE_BYTES; a longer text is a slice of its own."""
    start = total = 0
    for i, raw in enumerate(raws):
        total += len(raw or b"")
        if total >= SLICE_BYTES:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(raws):
        yield start, len(raws)
