"""Best-fit packing of tokenised documents into sequences of a fixed length.

How many pieces there are of each length (at most ``capacity`` numbers, however
large the corpus) decides the packing. The driver solves bin packing over that
histogram by bin completion; the result is a list of fillings with how often
each is used. Every piece then finds its place from its rank among the pieces
of its length, so no piece, group or sequence ever gathers in one task.

Rules: a null or empty text is a document of the end id alone; repeated rows are
documents of their own; a null doc_id stays null; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import broadcast_if_small, column, landed

#: Steps that the search may take (items tried in fillings) before it keeps the best solution so far.
STEP_BUDGET = 150_000
#: Bytes of text given to the encoder at once.
ENCODE_BYTES = 1 << 19
#: Most rows of the (input partition, length) offsets that are broadcast.
BROADCAST_ROWS = 200_000

PIECE_SCHEMA = ("doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")
PLACED_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


# ---------------------------------------------------------------- planning

Filling = tuple[int, ...]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    """Martello-Toth bound: no packing uses fewer sequences."""
    if not hist:
        return 0
    lengths = sorted(hist)
    total = sum(n * c for n, c in hist.items())
    best = -(-total // capacity)
    for k in [x for x in lengths if 2 * x <= capacity]:
        alone = sum(c for n, c in hist.items() if n > capacity - k)
        mid = {n: c for n, c in hist.items() if n <= capacity - k and 2 * n > capacity}
        free = sum((capacity - n) * c for n, c in mid.items())
        small = sum(n * c for n, c in hist.items() if k <= n and 2 * n <= capacity)
        best = max(best, alone + sum(mid.values()) + max(0, -(-(small - free) // capacity)))
    return max(best, sum(c for n, c in hist.items() if 2 * n > capacity))


def best_fit_decreasing(hist: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, equal lengths placed together; the first incumbent."""
    bins: dict[int, dict[Filling, int]] = {}
    rooms: list[int] = []  # sorted rooms left that some bin has

    def add(room: int, filling: Filling, n: int) -> None:
        if room not in bins:
            bins[room] = {}
            bisect.insort(rooms, room)
        bins[room][filling] = bins[room].get(filling, 0) + n

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                filling, n = bins[room].popitem()
                if not bins[room]:
                    del bins[room]
                    rooms.pop(i)
                use = min(n, left)
                if n > use:
                    add(room, filling, n - use)
                add(room - length, (*filling, length), use)
                left -= use
            else:
                each = min(capacity // length, left)
                n = left // each
                add(capacity - each * length, (length,) * each, n)
                left -= n * each
    return [(f, n) for group in bins.values() for f, n in group.items()]


def fillings(lengths: list[int], have: dict[int, int], top: int, room: int, spend: Callable[[], bool],
             deep: int = 6, width: int = 10, batch: int = 400) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of ways to fill ``room`` beside an item of length ``top``.

    One item that fits exactly dominates everything. Else the best of a short search
    come first: ``width`` lengths a step, the rest filled greedily behind ``deep``
    items. Then all maximal fillings follow, larger items first, each ``batch`` of
    steps by waste. ``spend`` counts a step and says whether the budget allows it.
    ``have`` must be as it was whenever the next filling is asked for.
    """
    def left(x: int) -> int:
        return have.get(x, 0) - (x == top)

    if left(room) > 0:
        spend()
        yield 0, (room,)
        return
    first: list[tuple[int, Filling]] = []
    best, done = room + 1, 0

    def keep(room: int, taken: Filling) -> None:
        nonlocal best
        if room < best:
            best = room
            first.append((room, taken))

    def greedy(room: int, most: int, taken: Filling) -> None:
        i = bisect.bisect_right(lengths, min(room, most)) - 1
        while i >= 0:
            n = min(left(lengths[i]) - taken.count(lengths[i]), room // lengths[i])
            taken, room = taken + (lengths[i],) * n, room - n * lengths[i]
            i = min(i, bisect.bisect_right(lengths, room)) - 1
        keep(room, taken)

    def grow(room: int, most: int, taken: Filling) -> None:
        nonlocal done
        done += 1
        if not spend():
            return
        if len(taken) >= deep:
            greedy(room, most, taken)
            return
        tried = 0
        for i in range(bisect.bisect_right(lengths, min(room, most)) - 1, -1, -1):
            x = lengths[i]
            if left(x) > taken.count(x):
                tried += 1
                grow(room - x, x, (*taken, x))
                if not best or done >= batch or tried == width:
                    return
        if not tried:
            keep(room, taken)

    grow(room, room, ())
    first.sort(key=lambda f: (f[0], len(f[1])))
    yield from first
    seen = {f for _, f in first}

    def every(room: int, i: int, taken: Filling, skipped: float) -> Iterator[tuple[int, Filling] | None]:
        """All maximal fillings and, as None, the steps between; ``skipped`` is the shortest length with items to spare."""
        i = min(i, bisect.bisect_right(lengths, room) - 1)
        while i >= 0 and left(lengths[i]) < 1:
            i -= 1
        yield None
        if i < 0:
            if room < skipped:
                yield room, taken
            return
        while i >= 0:
            x = lengths[i]
            for n in range(min(left(x), room // x), 0, -1):
                yield from every(room - n * x, i - 1, taken + (x,) * n, min(skipped, x) if n < left(x) else skipped)
            if left(x) > 0:
                skipped = min(skipped, x)
            i -= 1

    some: list[tuple[int, Filling]] = []
    steps = 0
    for got in every(room, len(lengths) - 1, (), math.inf):
        if got is not None and got[1] not in seen:
            some.append(got)
        if got is None:
            steps += 1
            if not spend():
                return
            if steps % batch == 0:
                yield from sorted(some)
                some = []
    yield from sorted(some)


def plan_packing(hist: dict[int, int], capacity: int, step_budget: int = STEP_BUDGET) -> list[tuple[Filling, int]]:
    """Fillings with how often each is used; every length's count is used up.

    Bin completion: the largest length left is completed by its maximal fillings,
    made as they are needed, each applied as often as the counts allow; a branch whose waste can no longer beat the incumbent is cut. The
    search ends at the lower bound or after ``step_budget`` steps.
    """
    hist = {n: c for n, c in hist.items() if c}
    if not hist:
        return []
    total = sum(n * c for n, c in hist.items())
    bound = lower_bound(hist, capacity)
    best = best_fit_decreasing(hist, capacity)
    used = sum(c for _, c in best)
    steps = 0
    counts = dict(hist)
    lengths = sorted(counts)
    path: list[tuple[Filling, int]] = []

    def take(filling: Filling, times: int) -> None:
        for x in filling:
            counts[x] -= times
            if not counts[x]:
                del counts[x]
                lengths.pop(bisect.bisect_left(lengths, x))

    def give(filling: Filling, times: int) -> None:
        for x in filling:
            if x not in counts:
                counts[x] = 0
                bisect.insort(lengths, x)
            counts[x] += times

    def spend() -> bool:
        nonlocal steps
        steps += 1
        return steps < step_budget

    def options() -> Iterator[tuple[int, Filling]]:
        top = lengths[-1]
        return ((w, (top, *f)) for w, f in fillings(lengths, counts, top, capacity - top, spend))

    def times_of(filling: Filling) -> int:
        return min(counts[x] // filling.count(x) for x in set(filling))

    # An explicit stack: a path may hold thousands of fillings.
    stack = [options()] if used > bound else []
    waste, wastes, n_used = 0, [], 0
    while stack and steps < step_budget:
        allowed = (used - 1) * capacity - total
        step = next(stack[-1], None)
        if step is not None:
            steps += 1
            w, filling = step
            times = times_of(filling)
            if waste + w * times > allowed and (times := (allowed - waste) // w if w else times) < 1:
                continue  # this filling cannot be part of a better solution
            take(filling, times)
            path.append((filling, times))
            wastes.append(w * times)
            waste += w * times
            n_used += times
            if not counts:
                best, used = list(path), n_used
                if used <= bound:
                    break
                stack.append(iter(()))
            else:
                stack.append(options())
            continue
        stack.pop()
        if path:
            filling, times = path.pop()
            give(filling, times)
            waste -= wastes.pop()
            n_used -= times
    return merged(best)


def merged(plan: list[tuple[Filling, int]]) -> list[tuple[Filling, int]]:
    out: dict[Filling, int] = {}
    for f, n in plan:
        f = tuple(sorted(f, reverse=True))
        out[f] = out.get(f, 0) + n
    return sorted(out.items(), reverse=True)


def slots(plan: list[tuple[Filling, int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per length: first rank, first sequence and offset of each run of places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    have: dict[int, int] = {}
    sequence = 0
    for filling, n in plan:
        at = 0
        for x in filling:
            runs.setdefault(x, []).append((have.get(x, 0), sequence, at))
            have[x] = have.get(x, 0) + n
            at += x
        sequence += n
    return {x: tuple(np.array(c, np.int64) for c in zip(*r)) for x, r in runs.items()}


# ---------------------------------------------------------------- Spark

def piece_table(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece, with its number ``nth`` among the pieces of its length in its input partition."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = bpe.encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            ids, texts = column(batch, "doc_id"), column(batch, "text").fill_null("")
            for rows in row_runs(texts, ENCODE_BYTES):
                out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
                for doc, got in zip(ids.slice(rows.start, len(rows)).to_pylist(), enc.encode(texts.slice(rows.start, len(rows)).to_pylist())):
                    got += end
                    n = len(got) // 4
                    first = n % capacity or capacity
                    for piece, (a, b) in enumerate(zip([0, *range(first, n, capacity)], range(first, n + 1, capacity))):
                        out["doc_id"].append(doc)
                        out["piece"].append(piece)
                        out["start"].append(a)
                        out["length"].append(b - a)
                        out["ids_crc32"].append(zlib.crc32(got[4 * a:4 * b]))
                nth = []
                for x in out["length"]:
                    nth.append(int(seen[x]))
                    seen[x] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()),
                     pa.array(out["length"], pa.int64()), pa.array(out["ids_crc32"], pa.int64()),
                     pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECE_SCHEMA)


def row_runs(texts: pa.Array, size: int) -> Iterator[range]:
    """Runs of rows of about ``size`` bytes of text."""
    import pyarrow.compute as pc

    sums = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) if len(texts) else []
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sums, (sums[i - 1] if i else 0) + size, "right")))
        yield range(i, j)
        i = j


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = 2048, end_id: int = 0,
         step_budget: int = STEP_BUDGET) -> DataFrame:
    """Pack all documents; returns one row per piece with its sequence and offset.

    A document's ids (with ``end_id`` behind them) longer than ``capacity`` are
    cut into pieces of ``capacity``, the first one taking the remainder.
    """
    spark = docs.sparkSession
    pieces = landed(piece_table(docs, vocabulary or bpe.default_vocabulary(), capacity, end_id), "pieces")
    by_part = landed(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    hist = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    runs = spark.sparkContext.broadcast(slots(plan_packing(hist, capacity, step_budget)))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = landed(by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-offsets")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = column(b, "length").to_numpy()
            rank = column(b, "nth").to_numpy() + column(b, "before").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                first, seq, at = runs.value[int(x)]
                rows = np.flatnonzero(length == x)
                k = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows] = seq[k] + rank[rows] - first[k]
                offset[rows] = at[k]
            yield pa.RecordBatch.from_arrays(
                [*(column(b, c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return pieces.join(broadcast_if_small(offsets, BROADCAST_ROWS), ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "nth", "before").mapInArrow(place, PLACED_SCHEMA)


def waste_fraction(packed: DataFrame, capacity: int = 2048) -> float:
    """Share of all sequence positions that no piece fills."""
    r = packed.agg(F.sum("length").alias("t"), (F.max("sequence_id") + 1).alias("s")).first()
    return 1 - r["t"] / (r["s"] * capacity) if r["s"] else math.nan
