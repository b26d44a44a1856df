"""Word shingles, their MinHash values and exact similarities, on numpy arrays."""

from __future__ import annotations

import numpy as np

WIDTH = 5
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = _RNG.integers(1, 1 << 63, WIDTH, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_held = {"n": 0, "up": _powers(_BASE, 0), "down": _powers(_INVERSE, 0)}


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (runs of non-blanks, A-Z lower-cased), and words a text."""
    raw = [t.encode() for t in texts]
    ends = np.cumsum([len(r) + 1 for r in raw])
    b = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(b):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    if _held["n"] < len(b):
        _held.update(n=len(b), up=_powers(_BASE, len(b)), down=_powers(_INVERSE, len(b)))
    blank = _BLANK[b]
    start = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    end = np.flatnonzero(~blank & np.r_[blank[1:], True])
    total = _BYTE[_LOWER[b]]  # eight bytes a byte of text: worked on in place
    total *= _held["up"][: len(b)]
    np.cumsum(total, out=total)
    sums = total[end] - np.where(start > 0, total[start - 1], np.uint64(0))
    words = mix(sums * _held["down"][start] + (end - start + 1).astype(np.uint64))
    return words, np.diff(np.searchsorted(start, np.r_[0, ends]))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of `width` (at most WIDTH) words, and their number a text; a shorter text is one shingle."""
    first = np.r_[0, np.cumsum(counts)]
    padded = np.r_[words, np.zeros(width, np.uint64)]
    left = np.repeat(first[1:], counts) - np.arange(len(words))  # words of the text from here on
    run = np.zeros(len(words), np.uint64)
    for k in range(width):
        run += np.where(left > k, padded[k : len(words) + k], np.uint64(0)) * _PLACE[k]
    run = mix(run + np.minimum(left, width).astype(np.uint64))
    here = left >= width
    short = (counts > 0) & (counts < width)
    here[first[:-1][short]] = True
    return run[here], np.where(short, 1, np.maximum(counts - width + 1, 0))


def fingerprints(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits of every text's word sequence, as rows of two uint64."""
    first = np.r_[0, np.cumsum(counts)]
    at = np.arange(len(words)) - np.repeat(first[:-1], counts)
    most = int(counts.max(initial=0)) + 1
    out = []
    for base in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F):
        total = np.r_[np.uint64(0), np.cumsum(words * _powers(base, most)[at])]
        out.append(mix(total[first[1:]] - total[first[:-1]] + counts.astype(np.uint64)))
    return np.stack(out, 1)


class MinHash:
    """k MinHash values of sets given as flat hashes with their numbers."""

    def __init__(self, k: int, chunk: int = 1 << 17) -> None:
        rng = np.random.default_rng(7)
        self.k, self.chunk = k, chunk
        self.add = rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1)
        self.times = rng.integers(0, 1 << 63, k, dtype=np.uint64) << np.uint64(1) | np.uint64(1)

    def __call__(self, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Rows of k values; all ones for an empty set."""
        out = np.full((self.k, len(counts)), np.iinfo(np.uint64).max, np.uint64)
        sets = np.flatnonzero(counts)
        starts = np.r_[0, np.cumsum(counts[sets])]
        at = 0
        while at < len(sets):
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + self.chunk, "right")) - 1)
            x = flat[starts[at] : starts[to]]
            cuts = starts[at:to] - starts[at]
            buffer = np.empty_like(x)
            for k in range(self.k):
                np.bitwise_xor(x, self.add[k], out=buffer)
                np.multiply(buffer, self.times[k], out=buffer)
                out[k, sets[at:to]] = np.minimum.reduceat(buffer, cuts)
            at = to
        return out.T


def bands(signature: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for each run of `rows` values; the band's number is part of the key."""
    n = signature.shape[1] // rows
    out = np.empty((len(signature), n), np.uint64)
    for i in range(n):
        key = np.full(len(signature), i + 1, np.uint64)
        for j in range(rows):
            key = mix(key * np.uint64(_BASE) + signature[:, i * rows + j])
        out[:, i] = key
    return out
