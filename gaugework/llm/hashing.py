"""Vectorised word and shingle hashing shared by the set-based text operators.

Everything here is plain numpy over one document at a time and is used from Arrow-batched
functions, so no state crosses documents and any executor can redo any batch.
"""

from __future__ import annotations

import numpy as np

#: Odd multiplier of the polynomial word hash and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MASK = (1 << 64) - 1


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on unsigned 64-bit integers."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = splitmix(np.arange(256, dtype=np.uint64) * np.uint64(0x100000001B3) + np.uint64(7))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_POWERS = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, kept between calls up to a million entries."""
    global _POWERS
    if len(_POWERS[0]) >= n:
        return _POWERS
    size = 1 << max(12, (n - 1).bit_length())
    up, down = np.full(size, _BASE, dtype=np.uint64), np.full(size, _INVERSE, dtype=np.uint64)
    up[0] = down[0] = 1
    made = np.multiply.accumulate(up), np.multiply.accumulate(down)
    if size <= 1 << 20:
        _POWERS = made
    return made


def words_of(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased UTF-8 bytes of a text and the begins and ends of its words ``[^\\x20\\x09-\\x0D]+``.

    Only A-Z are lowered. A null or blank text has no words.
    """
    raw = _LOWER[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    inside = np.zeros(len(raw) + 2, dtype=np.int8)
    inside[1:-1] = ~_SPACE[raw]
    step = np.diff(inside)
    return raw, np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(text: str | None) -> np.ndarray:
    """One 64-bit hash for each word, in order of the text."""
    raw, begins, ends = words_of(text)
    if not len(begins):
        return np.zeros(0, dtype=np.uint64)
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=total[1:])
    return splitmix((total[ends] - total[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n-word shingles in order; fewer words make one shingle; no words make none."""
    if not len(words):
        return words
    n_here = min(n, len(words))
    out = np.full(len(words) - n_here + 1, n_here, dtype=np.uint64)
    for k in range(n_here):
        out = splitmix(out * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(out)])
    return out


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(word_hashes(text), n))
