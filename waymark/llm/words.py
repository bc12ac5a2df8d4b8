"""Hashes of the words of a text, the same in every process, computed with numpy."""

from __future__ import annotations

import numpy as np

_LONGEST = 4096


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    x = 1
    for i in range(n):
        out[i] = x
        x = x * base % 2**64
    return out


_POWERS = _powers(0x9E3779B97F4A7C15, _LONGEST)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each run of bytes other than ASCII white space, in order."""
    b = np.frombuffer(text, np.uint8)
    inside = ~_SPACE[b]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    values = (b[inside].astype(np.uint64) + np.uint64(1)) * _POWERS[place % _LONGEST]
    return mix64(np.add.reduceat(values, first) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words; none if there are fewer."""
    m = len(words) - n + 1
    if m < 1:
        return np.zeros(0, np.uint64)
    total = np.full(m, n, np.uint64)
    for k in range(n):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[k : k + m]
    return mix64(total)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """The distinct word shingles of a text with A-Z lower-cased, as sorted hashes. A text of fewer words has its whole
    sequence as the only one; without words the set is empty."""
    words = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    return np.unique(gram_hashes(words, min(width, max(1, len(words)))))
