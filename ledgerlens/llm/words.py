"""Words and word shingles of UTF-8 text, hashed by whole Arrow slices in numpy.

A word is a run of bytes outside ``\\x20\\x09-\\x0D``. Hashes are 64 bits wide:
a polynomial over a random byte table, finished by a bit mixer. Two different
words (or shingles) of one document, or of one compared pair, share a hash with
probability about 2**-64 a pair.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15 | 1
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_SEG = 1 << 20
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, _SEG + 4096)
        a = np.full(m, U(_P))
        a[0] = 1
        b = np.full(m, U(pow(_P, -1, 1 << 64)))
        b[0] = 1
        _pow, _inv = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow, _inv


def mix(x: np.ndarray) -> np.ndarray:
    """Finisher of 64-bit hashes (splitmix)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, word offsets): byte ranges of all words; row r has words wo[r]:wo[r+1]."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    w = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True  # a document's ends also end words
    first = w.copy()
    first[1:] &= ~w[:-1] | edge[1:-1]
    last = w.copy()
    last[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word; works through segments of whole words, so memory stays bounded."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        base = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, base + _SEG, "right")))
        seg = data[base:int(ends[j - 1])]
        if lower:
            seg = LOWER[seg]
        p, inv = _powers(len(seg) + 1)
        cs = np.zeros(len(seg) + 1, np.uint64)
        np.cumsum(_BYTE[seg] * p[:len(seg)], out=cs[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        out[i:j] = mix((cs[e] - cs[s]) * inv[s] + (e - s).astype(np.uint64) * U(0xD6E8FEB86659FD93))
        i = j
    return out


def shingle_hashes(h: np.ndarray, wo: np.ndarray, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets) of the k-word windows of each row, in order, repeats kept.

    With ``short``, a row of 1..k-1 words has its whole sequence as one shingle;
    else it has none. A row without words has none.
    """
    n = np.diff(wo)
    count = np.maximum(n - k + 1, 0)
    if short:
        count = np.where((n > 0) & (n < k), 1, count)
    so = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(so[-1]), np.uint64)
    if not len(out):
        return out, so
    rows = np.repeat(np.arange(len(n)), count)
    at = wo[rows] + (np.arange(len(out)) - so[rows])
    size = np.minimum(n[rows], k)
    acc = size.astype(np.uint64) * U(0xA0761D6478BD642F)
    for i in range(k):
        inside = size > i
        nxt = h[np.minimum(at + i, len(h) - 1)]
        acc = np.where(inside, mix(acc ^ nxt) + U(i + 1), acc)
    return mix(acc), so
