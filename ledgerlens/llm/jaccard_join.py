"""Exact Jaccard self-join of word-shingle sets by universe partitioning.

Sets are grouped in bands by size. For a band, the hash universe is cut into m
segments. Two linked sets differ in at most H shingles (H follows from the sizes
and the threshold), so of m > H segments at least m - H hold the same shingles
on both sides. A signature stands for a non-empty segment's content; a set is
indexed under its own band, and under the band below if it can link into it.

1. Equal sets become one class; only class representatives go on.
2. Signatures are counted. A set that shares fewer than m - H segments with
   others has no partner and leaves with its signatures; this repeats while it
   still removes sets.
3. Allocation by cost: a set must look into H + 1 of its segments. Segments that
   nobody shares cost nothing; of the others it takes those with the smallest
   posting lists. A set with so many empty segments that too few are left looks
   into its fullest segments up to one deletion, which counts twice: signatures
   of a segment with one shingle removed are matched against whole segments.
   They are made for the needed segments only.
4. Long posting lists are joined as stars first: every set is compared with one set of
   its list, and linked sets become components. Rounds with other heads follow while they
   find links; after that only sets of different components can be needed pairs. Pairs
   must also pass a bound from parity sketches (their distance never exceeds the sets'
   difference) of 256 bits, in long lists of 1,024.
5. Short lists are joined within. Sets of long lists that still hold several components go
   on with the finest partition, segments of a single hash value: a value counts if
   sets of two components have it, a set with too few such values leaves with its
   values, and of the others a set looks into its rarest ones, as many as a
   linked set cannot all lack. Sets that share only a passage with many others, and
   components that share only that, leave here without being paired.
6. Every remaining pair is verified on the sets; links give components.

Shingles are 64-bit hashes (see ``words``); a wrong comparison needs two different
shingles of one pair of documents to collide.

Rules: null or blank text has an empty set, linked with nothing; a row without
doc_id takes part but names no component (its id is then null unless another
member has one); repeated rows are one class; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .common import all_columns, broadcast_if_small, column, landed, text_slices
from .components import components
from .words import U, mix, shingle_hashes, word_bounds, word_hashes

#: Most rows of identifier or signature tables that are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Posting lists from this length on are joined as stars, then by the finest partition.
STAR_ROWS = 16
#: A class with more than 1/HEAVY_PARTS of all rows is joined by broadcast (there are fewer than HEAVY_PARTS).
HEAVY_PARTS = 1000

_STARTS = [1]
while _STARTS[-1] < 1 << 40:
    _STARTS.append(max(_STARTS[-1] + 1, _STARTS[-1] * 3 // 2))
SKETCH = ["k0", "k1", "k2", "k3"]
#: Longs of the finer sketch that the sets of long lists carry.
FINE_SKETCH = 16
#: Links that a round of stars must find, per set that takes part, for another round to follow.
STAR_YIELD = 0.05
ROW_SCHEMA = ("uid long, doc_id long, n long, d1 long, d2 long, k0 long, k1 long, k2 long, k3 long, fine array<long>, "
              "s0 array<long>, need0 int, empty0 int, up0 array<int>, s1 array<long>, need1 int, empty1 int, up1 array<int>")


def most_apart(total: int, percent: int) -> int:
    """Largest difference of two linked sets whose sizes add up to ``total`` or less."""
    return total * (100 - percent) // (100 + percent)


def band(n: int) -> int:
    return bisect_right(_STARTS, n) - 1


@lru_cache(maxsize=4096)
def scheme(b: int, percent: int) -> tuple[int, np.ndarray]:
    """Number of segments of band ``b`` (0: only equal sets can link) and their first hash values."""
    top = _STARTS[b + 1] - 1
    h = most_apart(top + top * 100 // percent, percent)
    m = h + 1 + 2 + (h + 1) // 4 if h else 0
    return m, np.array([(j << 64) // m for j in range(m)], np.uint64)


def roles(n: int, percent: int) -> list[tuple[int, int]]:
    """(band, most apart) under which a set of ``n`` shingles is indexed: its own band, then the one below if it can link into it."""
    b = band(n)
    out = [(b, most_apart(n + n * 100 // percent, percent))]
    if b and (top := _STARTS[b] - 1) * 100 >= percent * n:
        out.append((b - 1, most_apart(n + top, percent)))
    return [(c, h) if h and scheme(c, percent)[0] else (c, 0) for c, h in out]


def _segments(v: np.ndarray, weight_sums: np.ndarray, b: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(signatures of all segments, sizes, ends, salts); ``v`` sorted, so a segment is a run of it."""
    m, first = scheme(b, percent)
    ends = np.append(np.searchsorted(v, first[1:]), len(v))
    starts = np.concatenate(([0], ends[:-1]))
    salt = mix((np.arange(m, dtype=np.uint64) << U(16)) + U(b + 1))
    return mix((weight_sums[ends] - weight_sums[starts]) ^ salt), ends - starts, ends, salt


def shingle_sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray]]:
    """(slice, row in it, sorted distinct shingle hashes) of each row."""
    for rows, data, off in text_slices(batch):
        starts, ends, wo = word_bounds(data, off)
        win, so = shingle_hashes(word_hashes(data, starts, ends, lower=True), wo, k)
        for i in range(len(rows)):
            yield rows, i, np.unique(win[so[i]:so[i + 1]])


def _weights(v: np.ndarray) -> np.ndarray:
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(v + U(0x51ED270B2F3A6C11)))))


def _digest(v: np.ndarray, sums: np.ndarray) -> tuple[int, int]:
    return int(sums[-1].astype(np.int64)), int(mix(v ^ U(0x7F4A7C15F39CC060)).sum(dtype=np.uint64).astype(np.int64))


def _parity(v: np.ndarray) -> list[int]:
    odd = np.bincount((v >> U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _fine_parity(v: np.ndarray) -> np.ndarray:
    odd = np.bincount(((v >> U(40)) & U(64 * FINE_SKETCH - 1)).astype(np.int64), minlength=64 * FINE_SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _upgrades(sizes: np.ndarray, need: int, empty: int) -> list[int]:
    """Segments that a set looks into up to one deletion: as many as it lacks, the fullest first.

    -1 - j stands for looking into the empty segment j, when even that is too little.
    """
    lack = empty + 1 - need
    if lack <= 0:
        return []
    full = [int(j) for j in np.argsort(-sizes, kind="stable") if sizes[j]]
    up = full[:lack]
    return up + [-1 - int(j) for j in np.flatnonzero(sizes == 0)[:lack - len(up)]]


def signature_rows(docs: DataFrame, k: int, percent: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe.forget()
        uid = TaskContext.get().partitionId() << 40
        for batch in batches:
            for chunk in _chunks(shingle_sets(batch, k), 2000):
                out: list[list] = [[] for _ in range(18)]
                for rows, i, v in chunk:
                    sums = _weights(v)
                    vals = [uid, column(rows, "doc_id")[i].as_py(), len(v), *_digest(v, sums), *_parity(v), _fine_parity(v)]
                    uid += 1
                    for b, h in (roles(len(v), percent) + [(0, 0)])[:2] if len(v) else [(0, 0)] * 2:
                        if not h:
                            vals += [None, 0, 0, None]
                            continue
                        sig, sizes, _, _ = _segments(v, sums, b, percent)
                        empty = int(np.count_nonzero(sizes == 0))
                        need = len(sizes) - h
                        vals += [sig[sizes > 0].view(np.int64), need, empty, _upgrades(sizes, need, empty) or None]
                    for col, x in zip(out, vals):
                        col.append(x)
                yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [pa.int64()] * 9 + [longs] + [longs, pa.int32(), pa.int32(), ints] * 2
        names = ["uid", "doc_id", "n", "d1", "d2", *SKETCH, "fine", "s0", "need0", "empty0", "up0", "s1", "need1", "empty1", "up1"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return _texts(docs).mapInArrow(sign, ROW_SCHEMA)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _chunks(it: Iterator, size: int) -> Iterator[list]:
    """Runs of at most ``size`` items (and of bounded shingles)."""
    run, weight = [], 0
    for x in it:
        run.append(x)
        weight += len(x[2])
        if len(run) >= size or weight > 1_000_000:
            yield run
            run, weight = [], 0
    if run:
        yield run


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """n, d1, d2 and the set itself of every row."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(shingle_sets(batch, k), 2000):
                keys = [_digest(v, _weights(v)) for _, _, v in chunk]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(v) for _, _, v in chunk], pa.int64()), pa.array([a for a, _ in keys], pa.int64()),
                     pa.array([b for _, b in keys], pa.int64()), pa.array([v.view(np.int64) for _, _, v in chunk], pa.list_(pa.int64()))],
                    names=["n", "d1", "d2", "set"])

    return _texts(docs).mapInArrow(sets, "n long, d1 long, d2 long, set array<long>")


# ---------------------------------------------------------------- candidates

def posting_rows(reps: DataFrame) -> DataFrame:
    """x (2 * uid + role) and sig, one row per non-empty segment."""
    own = reps.select((F.col("uid") * 2).alias("x"), F.explode("s0").alias("sig"))
    below = reps.select((F.col("uid") * 2 + 1).alias("x"), F.explode("s1").alias("sig"))
    return own.unionByName(below)


def shared(rows: DataFrame) -> DataFrame:
    """Signatures that at least two sets have, one of them in its own band."""
    return rows.groupBy("sig").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.col("x").bitwiseAND(1)).alias("role")) \
        .filter("cnt > 1 and role = 0").drop("role")


def peel(rows: DataFrame, needs: DataFrame) -> DataFrame:
    """Drop sets that share too few segments until that removes little more; returns x, sig, cnt, c."""
    n_rows = rows.count()
    while True:
        enough = rows.groupBy("x").agg(F.count(F.lit(1)).alias("c")).join(needs, "x").filter("c + empty >= need").select("x")
        rows = landed(rows.select("x", "sig").join(enough, "x", "left_semi"), "postings")
        rows = landed(rows.join(broadcast_if_small(landed(shared(rows), "shared"), BROADCAST_ROWS), "sig"), "postings")
        left = rows.count()
        if left > 0.95 * n_rows or not left:
            break
        n_rows = left
    return rows


def near(percent: int, fine: bool = False) -> F.Column:
    """Whether the sizes and sketches of x and y allow a link."""
    total = F.col("n") + F.col("yn")
    if fine:
        bits = [F.bit_count(F.col("fine")[i].bitwiseXOR(F.col("yfine")[i])) for i in range(FINE_SKETCH)]
    else:
        bits = [F.bit_count(F.col(k).bitwiseXOR(F.col("y" + k))) for k in SKETCH]
    return (100 * F.least("n", "yn") >= percent * F.greatest("n", "yn")) \
        & (sum(bits, F.lit(0)) <= F.floor(total * (100 - percent) / (100 + percent)))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold."""
    pairs = landed(pairs.select("a", "b").distinct(), "pairs")
    some = broadcast_if_small(landed(pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct(), "pair-ids"), BROADCAST_ROWS)
    sets = sets.join(some, "uid", "left_semi")
    got = pairs.join(sets.select(F.col("uid").alias("a"), F.col("set").alias("sa")), "a") \
        .join(sets.select(F.col("uid").alias("b"), F.col("set").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return landed(got.filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct(), "links")


def deletion_rows(docs: DataFrame, rows: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """uid, kind (0: a whole segment, 1: one with a shingle removed), sig, look, cnt of the segments that some
    sets look into up to one deletion; None if there are none."""
    wanted = []
    for role in (0, 1):
        up = rows.filter(f"up{role} is not null").select("n", F.explode(f"up{role}").alias("j")).distinct()
        wanted += [(roles(r["n"], percent)[role][0], r["j"] if r["j"] >= 0 else -1 - r["j"]) for r in up.toLocalIterator()]
    if not wanted:
        return None
    segs: dict[int, list[int]] = {}  # at most the segments of all bands
    for b, j in sorted(set(wanted)):
        segs.setdefault(b, []).append(j)

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in _chunks(shingle_sets(batch, k), 500):
                out: list[list] = [[] for _ in range(6)]
                for _, _, v in chunk:
                    for b, h in roles(len(v), percent) if len(v) else []:
                        if not h or b not in segs:
                            continue
                        sums = _weights(v)
                        sig, sizes, ends, salt = _segments(v, sums, b, percent)
                        need = len(sizes) - h
                        looks = set(_upgrades(sizes, need, int(np.count_nonzero(sizes == 0))))
                        for j in segs[b]:
                            a, e = int(ends[j] - sizes[j]), int(ends[j])
                            less = mix(((sums[e:e + 1] - sums[a:a + 1]) - (sums[a + 1:e + 1] - sums[a:e])) ^ salt[j:j + 1]).view(np.int64).tolist()
                            flag = 1 if j in looks else 2 if -1 - j in looks else 0
                            for kind, s in [(0, int(sig[j].astype(np.int64))), *((1, s) for s in less)]:
                                for col, x in zip(out, (len(v), *_digest(v, sums), kind, s, flag)):
                                    col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["n", "d1", "d2", "kind", "sig", "look"])

    made = _texts(docs).mapInArrow(neighbours, "n long, d1 long, d2 long, kind long, sig long, look long")
    made = landed(made.join(classes.select("n", "d1", "d2", F.col("rep").alias("uid")), ["n", "d1", "d2"])
                  .select("uid", "kind", "sig", "look").distinct(), "deletions")
    often = made.groupBy("sig").agg(F.count_distinct("uid").alias("cnt"), F.max("look").alias("asked")).filter("cnt > 1 and asked > 0")
    return landed(made.join(broadcast_if_small(landed(often.select("sig", "cnt"), "deletion-lists"), BROADCAST_ROWS), "sig"), "deletions")


def deletion_pairs(short: DataFrame) -> DataFrame:
    """Candidates of short lists of deletions."""
    x, y = short.filter("look > 0"), short.select(F.col("uid").alias("y"), F.col("kind").alias("ykind"), F.col("sig").alias("ysig"))
    meet = ((F.col("look") == 1) & (F.col("kind") != F.col("ykind"))) | ((F.col("look") == 2) & (F.col("kind") + F.col("ykind") == 0))
    return x.join(y, F.col("sig") == F.col("ysig")).filter((F.col("uid") != F.col("y")) & meet) \
        .select(F.least("uid", "y").alias("a"), F.greatest("uid", "y").alias("b")).distinct()


def with_components(rows: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Rows with the component ``comp`` of their uid (a set by itself: its own number)."""
    if comp is None:
        return rows.withColumn("comp", F.col("uid"))
    return rows.join(broadcast_if_small(comp, BROADCAST_ROWS), "uid", "left").withColumn("comp", F.coalesce("comp", "uid"))


def star_rounds(lists: DataFrame, sets: DataFrame, percent: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Links found by comparing the sets of long lists (sig, uid, n, sketch) with one set of their list, round
    after round with other heads while that finds links; and the components (uid, comp) that they make.

    A round makes at most as many pairs as the lists have rows; lists of one component leave."""
    found: list[DataFrame] = []
    comp: DataFrame | None = None
    wide = ["uid", "comp", "n", "fine"]
    rows = lists
    while True:
        rows = with_components(rows, comp)
        heads = landed(rows.groupBy("sig").agg(F.min(F.struct(F.xxhash64("uid", "sig", F.lit(len(found))).alias("o"), *wide)).alias("h"),
                                               F.min("comp").alias("low"), F.max("comp").alias("high"))
                       .filter("low != high").select("sig", *[F.col(f"h.{c}").alias("y" + c) for c in wide]), "heads")
        rows = landed(rows.join(broadcast_if_small(heads, BROADCAST_ROWS // 6), "sig"), "star-rows")
        star = rows.filter((F.col("comp") != F.col("ycomp")) & near(percent, fine=True)) \
            .select(F.least("uid", "yuid").alias("a"), F.greatest("uid", "yuid").alias("b"))
        links = verified(star, sets, percent)
        n_links = links.count()
        if not n_links:
            return found, comp
        found.append(links)
        # Components of components: links between their names.
        named = links if comp is None else with_names(links, comp)
        joined = components(named).select(F.col("node").alias("old"), F.col("label").alias("new"))
        if comp is None:
            comp = joined.select(F.col("old").alias("uid"), F.col("new").alias("comp"))
        else:
            small = broadcast_if_small(joined, BROADCAST_ROWS)
            moved = comp.join(small, F.col("comp") == F.col("old"), "left").select("uid", F.coalesce("new", "comp").alias("comp"))
            fresh = joined.select(F.col("old").alias("uid"), F.col("new").alias("comp")) \
                .join(broadcast_if_small(comp.select("uid"), BROADCAST_ROWS), "uid", "left_anti")
            comp = landed(moved.unionByName(fresh), "star-components")
        if n_links < STAR_YIELD * rows.select("uid").distinct().count():  # what is left is for the finest partition
            return found, comp
        rows = rows.select("sig", "uid", "n", "fine")


def with_names(links: DataFrame, comp: DataFrame) -> DataFrame:
    """Links between the components of their ends."""
    a, b = (broadcast_if_small(comp, BROADCAST_ROWS).select(F.col("uid").alias(c), F.col("comp").alias("c" + c)) for c in "ab")
    return landed(links.join(a, "a", "left").join(b, "b", "left")
                  .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct(), "component-links")


def finest_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Candidates (a, b) of different components among ``members`` (uid, comp, n, sketch), by segments of one hash
    value each; None if there are none.

    Two linked sets of different components have at least ``percent`` per cent of the larger one's values in common,
    and each of these values is held in two components. In the order of their frequency, the first value that they
    share comes before a set has passed as many of its counted values as the other one may lack."""
    need = F.ceil(F.col("n") * percent / F.lit(100))
    values = sets.join(broadcast_if_small(members.select("uid", "comp", "n"), BROADCAST_ROWS), "uid") \
        .select("uid", "comp", need.cast("long").alias("need"), F.explode("set").alias("v"))
    n_rows = None
    while True:
        both = values.groupBy("v").agg(F.count(F.lit(1)).alias("cnt"), F.min("comp").alias("low"), F.max("comp").alias("high")) \
            .filter("low != high").select("v", "cnt")
        counted = landed(values.join(both, "v"), "counted-values")
        enough = landed(counted.groupBy("uid").agg(F.count(F.lit(1)).alias("c"), F.first("need").alias("need")).filter("c >= need").select("uid", "c"), "enough")
        values = landed(counted.join(broadcast_if_small(enough, BROADCAST_ROWS), "uid"), "fine-values")
        left = values.count()
        if not left:
            return None
        if n_rows is not None and left > 0.9 * n_rows:
            break
        n_rows = left
        values = values.select("uid", "comp", "need", "v")
    rare = Window.partitionBy("uid").orderBy("cnt", "v")
    looks = values.withColumn("place", F.row_number().over(rare)).filter("place <= c - need + 1") \
        .select("uid", "v", (F.col("c") - F.col("place") + 1).alias("ahead"))
    looks = landed(looks.join(broadcast_if_small(members, BROADCAST_ROWS // 6), "uid"), "fine-looks")
    y = looks.select(F.col("v").alias("yv"), *[F.col(c).alias("y" + c) for c in ("uid", "ahead", "comp", "n", "fine")])
    # At the first value that they share, all that they share is ahead.
    enough = (100 + percent) * F.least("ahead", "yahead") >= percent * (F.col("n") + F.col("yn"))
    return looks.join(y, (F.col("v") == F.col("yv")) & (F.col("uid") > F.col("yuid")) & (F.col("comp") != F.col("ycomp"))
                      & enough & near(percent, fine=True)) \
        .select(F.col("yuid").alias("a"), F.col("uid").alias("b"))


def similar_groups(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row (and uid, rep: the row's and its class's internal numbers)."""
    assert 67 <= percent <= 100
    rows = landed(signature_rows(docs, k, percent), "signatures")
    n_rows = rows.count()
    key = ["n", "d1", "d2"]
    classes = landed(rows.filter("n > 0").groupBy(*key).agg(
        F.min("uid").alias("rep"), F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("copies")), "classes")
    n_classes = classes.count()
    ids = rows.filter("n > 0")
    if n_rows - n_classes <= BROADCAST_ROWS:
        copies = landed(ids.select("uid").join(classes.select(F.col("rep").alias("uid")), "uid", "left_anti"), "copies")
        reps = ids.join(F.broadcast(copies), "uid", "left_anti")
    else:
        reps = ids.join(classes.select(F.col("rep").alias("uid")), "uid", "left_semi")
    links = class_links(docs, reps, classes, k, percent)
    if links is not None:
        named = components(links)
        named = named.join(classes.select(F.col("rep").alias("node"), "low"), "node")
        lows = named.groupBy("label").agg(F.min("low").alias("component_id"))
        named = landed(named.select("node", "label").join(lows, "label").select(F.col("node").alias("rep"), "component_id"), "components")
        classes = classes.join(broadcast_if_small(named, BROADCAST_ROWS), "rep", "left") \
            .select(*key, "rep", "copies", F.coalesce("component_id", "low").alias("component_id"))
    else:
        classes = classes.select(*key, "rep", "copies", F.col("low").alias("component_id"))
    classes = landed(classes, "named-classes")
    slim = rows.select("uid", "doc_id", *key)
    heavy, light = classes.filter(F.col("copies") * HEAVY_PARTS > n_rows), classes.filter(F.col("copies") * HEAVY_PARTS <= n_rows)
    full = slim.filter("n > 0")
    cols = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "uid", "rep"]
    return full.join(F.broadcast(heavy), key).select(*cols) \
        .unionByName(full.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key).select(*cols)) \
        .unionByName(slim.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                                 F.col("doc_id").alias("component_id"), "uid", F.col("uid").alias("rep")))


def class_links(docs: DataFrame, reps: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame | None:
    """All links (a, b) that components need between class representatives; None if there are none."""
    rows = posting_rows(reps)
    known = landed(shared(rows), "shared")
    rows = landed(rows.join(broadcast_if_small(known, BROADCAST_ROWS), "sig").select("x", "sig"), "postings")
    facts = reps.select("uid", "n", *SKETCH, "fine")
    needs = reps.select((F.col("uid") * 2).alias("x"), F.col("need0").alias("need"), F.col("empty0").alias("empty")) \
        .unionByName(reps.select((F.col("uid") * 2 + 1).alias("x"), F.col("need1").alias("need"), F.col("empty1").alias("empty"))).filter("need > 0")
    rows = peel(rows, needs)
    loose = deletion_rows(docs, reps, classes, k, percent)
    if rows.isEmpty() and loose is None:
        return None
    # Allocation: the H + 1 cheapest segments; those that nobody shares are free.
    by_cost = Window.partitionBy("x").orderBy("cnt", "sig")
    rows = rows.join(needs, "x").withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("x"))) \
        .withColumn("look", F.row_number().over(by_cost) <= F.col("c") + F.col("empty") + 1 - F.col("need")) \
        .withColumn("uid", F.shiftright("x", 1)).withColumn("role", F.col("x").bitwiseAND(1))
    rows = landed(rows.select("uid", "role", "sig", "cnt", "look"), "allocation")
    ids = rows.select("uid") if loose is None else rows.select("uid").unionByName(loose.select("uid"))
    ids = landed(ids.distinct(), "candidate-ids")
    facts = landed(facts.join(broadcast_if_small(ids, BROADCAST_ROWS), "uid", "left_semi"), "candidate-facts")
    sets = candidate_sets(docs, classes, ids, k)
    small_facts = broadcast_if_small(facts, BROADCAST_ROWS // 6)
    rows = landed(rows.join(small_facts.drop("fine"), "uid"), "allocation")
    # Long lists: stars, then the finest partition for what is left in several components.
    asked = landed(rows.filter(F.col("look") & (F.col("cnt") >= STAR_ROWS)).select("sig").distinct(), "asked-lists")
    long = rows.filter(F.col("cnt") >= STAR_ROWS).join(broadcast_if_small(asked, BROADCAST_ROWS), "sig", "left_semi").select("sig", "uid")
    if loose is not None:
        long = long.unionByName(loose.filter(F.col("cnt") >= STAR_ROWS).select("sig", "uid"))
    long = landed(long.distinct().join(small_facts.select("uid", "n", "fine"), "uid"), "long-lists")
    links, comp = star_rounds(long, sets, percent)
    rows = landed(with_components(rows.filter(F.col("cnt") < STAR_ROWS), comp), "short-lists")
    # The set with the larger number looks for the other; pairs inside a component are not needed.
    y = rows.select(F.col("sig").alias("ysig"), *[F.col(c).alias("y" + c) for c in ("uid", "role", "n", "comp", *SKETCH)])
    pairs = rows.filter("look").join(y, (F.col("sig") == F.col("ysig")) & (F.col("uid") > F.col("yuid")) & (F.col("comp") != F.col("ycomp"))
                                     & (F.col("role") + F.col("yrole") < 2) & near(percent)) \
        .select(F.col("yuid").alias("a"), F.col("uid").alias("b"))
    if loose is not None:
        pairs = pairs.unionByName(deletion_pairs(loose.filter(F.col("cnt") < STAR_ROWS)))
    named = landed(with_components(long, comp), "long-lists")
    several = named.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high").select("sig")
    members = landed(named.join(broadcast_if_small(landed(several, "mixed-lists"), BROADCAST_ROWS), "sig", "left_semi")
                     .select("uid", "comp", "n", "fine").distinct(), "members")
    if not members.isEmpty():
        fine = finest_pairs(members, sets, percent)
        if fine is not None:
            pairs = pairs.unionByName(fine)
    links.append(verified(pairs, sets, percent))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return None if out.isEmpty() else out


def candidate_sets(docs: DataFrame, classes: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """uid and set of the candidate classes, made again from the text of one document of each."""
    chosen = landed(classes.join(broadcast_if_small(ids.withColumnRenamed("uid", "rep"), BROADCAST_ROWS), "rep", "left_semi")
                    .select("n", "d1", "d2", "rep", "low"), "candidate-classes")
    lows = broadcast_if_small(chosen.select(F.col("low").alias("_low")).distinct(), BROADCAST_ROWS)
    texts = _texts(docs)
    texts = texts.join(lows, texts["doc_id"].eqNullSafe(lows["_low"]), "left_semi")
    return landed(set_rows(texts, k).join(broadcast_if_small(chosen.drop("low"), BROADCAST_ROWS // 3), ["n", "d1", "d2"])
                  .select(F.col("rep").alias("uid"), "set"), "candidate-sets")


def shingle_join(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``."""
    return similar_groups(docs, k, percent).select("doc_id", "n_shingles", "component_id")


def drop_similar(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near-duplicates, with all their columns.

    Of each component the row with the smallest doc_id stays (null last, then any one).
    """
    n = docs.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("ids")).first()
    own = n["rows"] == n["ids"]  # else doc_ids repeat or are missing: rows get numbers of their own
    number = F.col("doc_id").cast("long") if own else F.monotonically_increasing_id()
    # The rows in a struct, so that none of their columns can be taken for one of these.
    rows = docs.select(number.alias("id"), F.struct(*all_columns(docs)).alias("row"))
    rows = rows if own else landed(rows, "numbered")
    groups, key = similar_groups(rows.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text")), k, percent), "component_id"
    if not own:
        named = landed(groups.join(rows.select(F.col("id").alias("doc_id"), F.col("row.doc_id").alias("name")), "doc_id"), "named")
        best = named.groupBy("component_id").agg(F.min(F.struct(F.col("name").isNull(), "name", F.col("doc_id").alias("stays"))).alias("m"))
        groups, key = named.join(landed(best.select("component_id", "m.stays"), "similar-first"), "component_id"), "stays"
    gone = landed(groups.filter(F.col("doc_id") != F.col(key)).select(F.col("doc_id").alias("id")), "similar-dropped")
    return rows.join(broadcast_if_small(gone, BROADCAST_ROWS), "id", "left_anti").select("row.*")
