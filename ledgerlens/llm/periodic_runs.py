"""Periodic runs of words: maximal stretches that repeat with their smallest period.

A run has smallest period q, at least max(12, 2 q) words, and no neighbouring word
extends it with period q kept. All runs of a text are found, whatever their period.

Words become numbers (equal words of one text: equal numbers; texts are divided by
numbers of their own). Blocks of 2^k words are numbered the same way from pairs
of half blocks, as long as a block occurs twice in its text, so equality of blocks
is exact and the longest common extension of two places takes one step a scale.

1. Periods under 16: the text is compared with itself at each lag.
2. Scale g = 8, 16, 32, ...: periods from 2g to 4g - 1. Of the g blocks (of g words)
   that begin at g neighbouring places, the least one is the minimizer. Inside a run
   the same window comes again one period later, so its minimizer does too: equal
   minimizers at a distance of 2g to 4g - 1 are seeds. Blocks that themselves
   repeat with a period of at most g/2 are no minimizers: they lie in runs that are
   known already. The other equal blocks lie more than g/2 apart, so a minimizer has
   at most eight partners.
3. Windows of a run that have no minimizer: then the run's first period lies in one
   run of a period p <= g/2 and its second one in another that overlaps or follows
   it at once. Every two such runs give as seeds the lags that shift one onto the other.
4. Every seed's lag is extended to both sides by the block numbers. Stretches of at
   least two periods are runs; of several on the same words the smallest period counts.

Rules: null and empty texts have no words and no runs; rows without or with a
repeated doc_id are rows like all others (a missing one plants no repetition); an
empty table gives no rows; other columns are not read. A text is held whole, with
one number a word and scale while blocks repeat.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, text_slices
from .words import U, mix, word_bounds, word_hashes

#: The fewest words of a run, and the periods found by comparing at each lag.
LEAST = 12
DIRECT = 16


def numbered(h: np.ndarray, wo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all rows end to end, a number of its own behind each row; first place of each row."""
    n = np.diff(wo)
    first = wo[:-1] + np.arange(len(n))
    rows = np.repeat(np.arange(len(n)), n)
    _, ids = np.unique(mix(h ^ mix(rows.astype(np.uint64) + U(0x632BE59BD9B4E019))), return_inverse=True)
    out = np.empty(len(h) + len(n), np.int64)
    out[np.arange(len(h)) + rows] = ids
    out[first + n] = len(h) + np.arange(len(n))
    return out, first


def block_numbers(words: np.ndarray) -> list[np.ndarray]:
    """For k = 0, 1, ...: the number of the block of 2^k words at each place, -1 where it comes only once."""
    count = np.bincount(words)
    levels = [np.where(count[words] > 1, words, -1)]
    size = 1
    while True:
        now = levels[-1]
        at = np.flatnonzero(now[:-size] >= 0)
        at = at[now[at + size] >= 0]
        if not len(at):
            return levels
        key = now[at] * np.int64(int(now.max()) + 1) + now[at + size]
        _, ids, count = np.unique(key, return_inverse=True, return_counts=True)
        keep = count[ids] > 1
        if not keep.any():
            return levels
        nxt = np.full(len(words), -1, np.int64)
        nxt[at[keep]] = ids[keep]
        levels.append(nxt)
        size *= 2


def _extend(levels: list[np.ndarray], words: np.ndarray, i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """Words that agree from i and j on (``back``: before them). Two blocks agree if their numbers do."""
    n = len(words)
    got = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        size, level = 1 << k, levels[k]
        act = np.arange(len(i))
        while len(act):  # only the largest blocks can agree several times in a row
            if back:
                a, b = i[act] - got[act] - size, j[act] - got[act] - size
                inside = a >= 0
            else:
                a, b = i[act] + got[act], j[act] + got[act]
                inside = b + size <= n
            act, a, b = act[inside], a[inside], b[inside]
            x = level[a]
            act = act[(x >= 0) & (x == level[b])]
            got[act] += size
            if k < len(levels) - 1:
                break
    return got


def _stretches(words: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches with period q of at least max(8, 2 q) words."""
    same = np.zeros(len(words) - q + 2, bool)
    same[1:-1] = words[:-q] == words[q:]
    edge = np.flatnonzero(same[1:] != same[:-1])
    s, e = edge[::2], edge[1::2] + q
    long = e - s >= max(8, 2 * q)
    return s[long], e[long]


def _window_minima(key: np.ndarray, width: int) -> np.ndarray:
    """Least of ``key[a:a + width]`` for every a; width is a power of two."""
    w = 1
    while w < width:
        key = np.minimum(key[:-w], key[w:])
        w *= 2
    return key


class _Runs:
    """Found stretches (start, end, period), no two on the same words."""

    def __init__(self):
        z = np.zeros(0, np.int64)
        self.s, self.e, self.q = z, z, z

    def add(self, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> None:
        s, e, q = np.concatenate((self.s, s)), np.concatenate((self.e, e)), np.concatenate((self.q, q))
        order = np.lexsort((q, e, s))
        s, e, q = s[order], e[order], q[order]
        first = np.ones(len(s), bool)
        first[1:] = (s[1:] != s[:-1]) | (e[1:] != e[:-1])
        self.s, self.e, self.q = s[first], e[first], q[first]


def _minimizer_seeds(level: np.ndarray, g: int, runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) of equal minimizers 2g to 4g - 1 words apart."""
    alive = np.flatnonzero(level >= 0)
    z = np.zeros(0, np.int64)
    if len(alive) < g:
        return z, z
    calm = (2 * runs.q <= g) & (runs.e - runs.s >= g)
    cover = np.zeros(len(level) + 1, np.int64)
    np.add.at(cover, runs.s[calm], 1)
    np.add.at(cover, runs.e[calm] - g + 1, -1)
    periodic = np.cumsum(cover[:-1])[alive] > 0
    # Order of blocks: by a mixed number; of equal ones in a window the first.
    key = (mix(level[alive].astype(np.uint64)) >> U(32) << U(31)).astype(np.int64) + np.arange(len(alive))
    key[periodic] = np.iinfo(np.int64).max
    least = _window_minima(key, g)
    whole = alive[g - 1:] - alive[:len(alive) - g + 1] == g - 1
    least = least[whole & (least < np.iinfo(np.int64).max)]
    place = np.unique(least & np.int64((1 << 31) - 1))
    if not len(place):
        return z, z
    at = alive[place]
    order = np.lexsort((at, level[at]))
    at = at[order]
    block = level[at]
    starts, lags = [], []
    step = 1
    act = np.arange(len(at) - 1)
    while len(act):
        act = act[act + step < len(at)]
        lag = at[act + step] - at[act]
        act = act[(block[act + step] == block[act]) & (lag < 4 * g)]
        lag = at[act + step] - at[act]
        good = lag >= 2 * g
        starts.append(at[act[good]])
        lags.append(lag[good])
        step += 1
    return np.concatenate(starts) if starts else z, np.concatenate(lags) if lags else z


def _neighbour_seeds(words: np.ndarray, g: int, runs: _Runs) -> tuple[np.ndarray, np.ndarray]:
    """(place, lag) that shift a run of period p <= g/2 onto the run of the same period that follows or overlaps it."""
    starts, lags = [], []
    calm = np.flatnonzero((2 * runs.q <= g) & (runs.e - runs.s >= 2 * g))
    order = calm[np.lexsort((runs.s[calm], runs.q[calm]))]
    s, e, q = runs.s[order], runs.e[order], runs.q[order]
    meet = np.flatnonzero((q[:-1] == q[1:]) & (s[1:] <= e[:-1]))
    for k in meet:
        p, a0, a1, b0, b1 = int(q[k]), int(s[k]), int(e[k]), int(s[k + 1]), int(e[k + 1])
        root = words[a1:a1 + p] if a1 + p <= b1 else words[a1 - p:a1]
        at = a1 if a1 + p <= b1 else a1 - p  # the root lies in the second run
        if at < b0:
            continue
        shift = [d for d in range(p) if np.array_equal(words[a1 - p - d:a1 - d], root)]
        if not shift:
            continue
        base = at - (a1 - p - shift[0])  # one lag that fits; all others differ by multiples of p
        lag = np.arange(2 * g + (base - 2 * g) % p, 4 * g, p)
        t = np.clip(b1 - lag, b0, a1)  # the border between the two periods
        ok = (t - lag >= a0) & (t + lag <= b1)
        starts.append((t - lag)[ok])
        lags.append(lag[ok])
    z = np.zeros(0, np.int64)
    return np.concatenate(starts) if starts else z, np.concatenate(lags) if lags else z


def runs_of(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, periods) of all runs of a number sequence, by start, then period."""
    runs = _Runs()
    n = len(words)
    if n >= LEAST:
        levels = block_numbers(words)
        found = [(_stretches(words, q), q) for q in range(1, min(DIRECT, n // 2 + 1))]
        runs.add(*(np.concatenate(x) for x in zip(*((s, e, np.full(len(s), q)) for (s, e), q in found))))
        k = 3
        while k < len(levels) and 4 << k <= n:
            g = 1 << k
            seeds = [_minimizer_seeds(levels[k], g, runs), _neighbour_seeds(words, g, runs)]
            i, lag = (np.concatenate(x) for x in zip(*seeds))
            if len(i):
                i, lag = np.unique(np.stack((i, lag)), axis=1)
                start = i - _extend(levels, words, i, i + lag, True)
                end = i + lag + _extend(levels, words, i, i + lag, False)
                good = end - start >= 2 * lag
                runs.add(start[good], end[good], lag[good])
            k += 1
    long = runs.e - runs.s >= LEAST
    order = np.lexsort((runs.q[long], runs.s[long]))
    return runs.s[long][order], runs.e[long][order], runs.q[long][order]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a document whose words are made to repeat; None if it stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def text_runs(rows: pa.RecordBatch, data: np.ndarray, off: np.ndarray, plant: bool) -> Iterator[tuple]:
    """Per row: (raw text, order of its words or None, starts, ends, periods), places numbered within the row."""
    starts, ends, wo = word_bounds(data, off)
    h = word_hashes(data, starts, ends)
    orders: list[np.ndarray | None] = [None] * len(rows)
    if plant:
        for r, doc in enumerate(column(rows, "doc_id").to_pylist()):
            orders[r] = planted(doc, int(wo[r + 1] - wo[r]))
            if orders[r] is not None:
                h[wo[r]:wo[r + 1]] = h[wo[r]:wo[r + 1]][orders[r]]
    words, first = numbered(h, wo)
    s, e, q = runs_of(words)
    cut = np.searchsorted(s, np.append(first, len(words)))
    for r in range(len(rows)):
        a, b = cut[r], cut[r + 1]
        yield data[off[r]:off[r + 1]], orders[r], s[a:b] - first[r], e[a:b] - first[r], q[a:b]


def collapsed(raw: np.ndarray, order: np.ndarray | None, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> bytes:
    """The words kept, joined by one space: of every run only its first period stays."""
    words = raw.tobytes().split()  # ASCII white space only
    if order is None and not len(s):
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, s + q, 1)
    np.add.at(cover, e, -1)
    keep = np.flatnonzero(np.cumsum(cover[:-1]) == 0)
    return b" ".join([words[i] for i in (keep if order is None else order[keep]).tolist()])


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, start, length, period of every run of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, off in text_slices(b):
                found = list(text_runs(rows, data, off, False))
                take = np.repeat(np.arange(len(rows)), [len(f[2]) for f in found])
                s, e, q = (np.concatenate([f[k] for f in found]) for k in (2, 3, 4))
                yield pa.RecordBatch.from_arrays(
                    [column(rows, "doc_id").take(pa.array(take)), *(pa.array(x, pa.int64()) for x in (s, e - s, q))],
                    names=["doc_id", "start", "length", "period"])

    return _texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """doc_id and the text of every row without its repetitions, words joined by one space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, off in text_slices(b):
                texts = [collapsed(*f).decode() for f in text_runs(rows, data, off, False)]
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return _texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, text string")


DIGEST_SCHEMA = ("n_runs long, start long, length long, period long, exponent_milli long, "
                 "runs_sha256 string, collapsed_sha256 string")


def run_digests(docs: DataFrame, plant: bool = True) -> DataFrame:
    """One row per document: the number of runs, the longest one (ties: least start, then period) and digests
    of all runs and of the collapsed text. ``plant`` makes a tenth of the documents repeat first (see ``planted``)."""
    kinds = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, data, off in text_slices(b):
                out: list[list] = [[] for _ in kinds]
                for raw, order, s, e, q in text_runs(rows, data, off, plant):
                    best = [None] * 4
                    if len(s):
                        k = int(np.argmax(e - s))
                        start, length, period = int(s[k]), int(e[k] - s[k]), int(q[k])
                        best = [start, length, period, 1000 * length // period]
                    lines = "".join(f"{a},{c - a},{p}\n" for a, c, p in zip(s.tolist(), e.tolist(), q.tolist()))
                    vals = [len(s), *best, hashlib.sha256(lines.encode()).hexdigest(),
                            hashlib.sha256(collapsed(raw, order, s, e, q)).hexdigest()]
                    for col, x in zip(out, vals):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([column(rows, "doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds))],
                                                 names=["doc_id", *(x.split()[0] for x in DIGEST_SCHEMA.split(", "))])

    return _texts(docs).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {DIGEST_SCHEMA}")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))
