"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition turns its texts into digests and sorts them into one run
per slice of the digest space. Runs of a slice then meet in rounds: run numbers
lose their last base-``RADIX`` digit each time, the runs that fall together are
merged, and equal digests become one entry with the identifier that stays and
their number. A copy-heavy text is one entry a run from the first round on. A
slice covers a bounded number of digests, so no merge grows with the corpus.

An entry's key is the SHA-256 digest with the text's length and a second,
independent hash; entries join only if all three agree, at every level.

Rules: null text counts as empty; texts are equal when identical after lower-casing
A-Z; the row with the largest (or smallest) doc_id stays, a null doc_id only if
the group has no other; of rows repeated with that doc_id one stays; an empty
table gives no rows; other columns are not read (``dedup`` keeps them).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_columns, broadcast_if_small, column, landed

#: Runs that meet in one merge, and digests that a slice holds on average.
RADIX, SLICE_DIGESTS = 2, 150_000
#: Groups of more than this share of all rows are joined by broadcast: at most HEAVY_PARTS of them exist.
HEAVY_PARTS = 1000
#: Most identifiers of rows to drop that are broadcast; beyond, the rows are joined by shuffle.
BROADCAST_IDS = 50_000
KEY_BYTES = 48
ROW_SCHEMA = "doc_id long, uid long, key binary"
RUN_SCHEMA = "slice int, run long, key binary, keep_id long, keep_uid long, n long"
_NONE = np.iinfo(np.int64).min


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, uid (input partition and position) and key of every row."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for b in batches:
            keys = []
            for text in pc.ascii_lower(column(b, "text").fill_null("")):
                raw = text.as_buffer()
                keys.append(hashlib.sha256(raw).digest() + xxhash.xxh64_digest(raw) + len(raw or b"").to_bytes(8, "big")
                            if raw is not None else _EMPTY)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(np.arange(at, at + len(b))), pa.array(keys, pa.binary())],
                                             names=["doc_id", "uid", "key"])
            at += len(b)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(digest, ROW_SCHEMA)


_EMPTY = hashlib.sha256(b"").digest() + xxhash.xxh64_digest(b"") + (0).to_bytes(8, "big")


def _keys(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Fixed-width keys as numpy byte strings, compared as a whole."""
    flat = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
    if not len(flat):
        return np.zeros(0, f"V{KEY_BYTES}").view(f"S{KEY_BYTES}")
    return np.frombuffer(b"".join(flat.to_pylist()), f"S{KEY_BYTES}")


def merge_runs(key: np.ndarray, keep: np.ndarray, uid: np.ndarray, n: np.ndarray, sign: int) -> tuple[np.ndarray, ...]:
    """One sorted run from sorted runs laid end to end; equal keys become one entry.

    The stable sort finds the runs that are there and merges them.
    """
    order = np.argsort(key, kind="stable")
    key, keep, uid, n = key[order], keep[order], uid[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    if not len(first):
        return key, keep, uid, n
    size = np.diff(np.append(first, len(key)))
    rank = np.where(keep == _NONE, _NONE, keep * sign)  # a null identifier never wins
    best = np.maximum.reduceat(rank, first)
    last = np.maximum.reduceat(np.where(rank == np.repeat(best, size), uid, -1), first)
    return key[first], np.where(best == _NONE, _NONE, best * sign), last, np.add.reduceat(n, first)


def _run_batch(slices, run, key, keep, uid, n) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(slices.astype(np.int32)), pa.array(np.full(len(n), run, np.int64)),
         pa.array([k.ljust(KEY_BYTES, b"\0") for k in key.tolist()], pa.binary()), pa.array(keep), pa.array(uid), pa.array(n)],
        names=["slice", "run", "key", "keep_id", "keep_uid", "n"])


def digest_groups(rows: DataFrame, n_rows: int, n_runs: int, keep: str = "largest") -> DataFrame:
    """key, keep_id, keep_uid, n of every distinct text, from landed digest rows."""
    sign = 1 if keep == "largest" else -1
    slices = 1 << max(0, math.ceil(math.log2(max(1, n_rows / SLICE_DIGESTS))))

    def first_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        parts = [(_keys(pa.array([], pa.binary())), *(np.zeros(0, np.int64) for _ in range(3)))]
        waiting = 0

        def merged() -> tuple:
            return merge_runs(*(np.concatenate(c) for c in zip(*parts)), sign)

        for b in batches:  # batches wait until they are as many as the run: each entry is sorted few times
            got = column(b, "doc_id").fill_null(int(_NONE)).to_numpy(zero_copy_only=False)
            parts.append((_keys(column(b, "key")), got, column(b, "uid").to_numpy(), np.ones(len(b), np.int64)))
            waiting += len(b)
            if waiting > len(parts[0][1]):
                parts, waiting = [merged()], 0
        key, ids, uid, n = merged()
        lead = np.array([int.from_bytes(k[:4].ljust(4, b"\0"), "big") for k in key.tolist()], np.int64)
        part = lead * slices >> 32
        for i in range(0, len(n), 50_000):
            s = slice(i, i + 50_000)
            yield _run_batch(part[s], run, key[s], ids[s], uid[s], n[s])

    def merge(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(group))
        key, ids, uid, n = merge_runs(_keys(t["key"]), *(t[c].to_numpy() for c in ("keep_id", "keep_uid", "n")), sign)
        where, run = t["slice"][0].as_py(), t["run"][0].as_py() // RADIX
        for i in range(0, len(n), 50_000):
            s = slice(i, i + 50_000)
            yield _run_batch(np.full(len(n[s]), where), run, key[s], ids[s], uid[s], n[s])

    runs = rows.mapInArrow(first_runs, RUN_SCHEMA)
    rounds = max(1, math.ceil(math.log(max(2, n_runs), RADIX)))
    for left in reversed(range(rounds)):
        meet = F.floor(F.col("run") / RADIX) if left else F.lit(0)  # in the last round all that is left meets
        runs = runs.withColumn("meet", meet.cast("long")).groupBy("slice", "meet").applyInArrow(
            _by_batches(merge), RUN_SCHEMA)
    none = F.col("keep_id") == F.lit(int(_NONE))
    return landed(runs.select("key", F.when(~none, F.col("keep_id")).alias("keep_id"), "keep_uid", "n"), "digest-groups")


def _by_batches(merge):
    def run(table: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table.select([c for c in table.column_names if c != "meet"])
        return pa.Table.from_batches(list(merge(iter(table.to_batches()))))
    return run


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row."""
    rows = landed(digest_rows(docs), "digests")
    n_rows = rows.count()
    groups = digest_groups(rows, n_rows, rows.rdd.getNumPartitions(), keep)
    heavy = groups.filter(F.col("n") * HEAVY_PARTS > n_rows)  # fewer than HEAVY_PARTS groups, whatever the corpus
    light = groups.filter(F.col("n") * HEAVY_PARTS <= n_rows)
    out = rows.join(F.broadcast(heavy), "key").unionByName(
        rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key"))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("uid") == F.col("keep_uid")).alias("kept"),
                      F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"))


def normalised_sha256(text: str) -> F.Column:
    return F.sha2(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")),
                              "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)


def dedup(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    groups = landed(exact_groups(docs, keep).select(
        F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"), "kept",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("same")), "dedup-groups")
    same = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha"))
    inner = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.col("doc_id").cast("long").alias("_id"), normalised_sha256("text").alias("_sha"))
    drop = landed(groups.filter("not same").select("_keep_id", "_keep_sha").distinct(), "dropped")
    got = inner.join(broadcast_if_small(drop, BROADCAST_IDS), same, "left_anti")
    again = landed(groups.filter("same and not kept").select("_keep_id", "_keep_sha").distinct(), "repeated")  # whole rows that repeat
    if not again.isEmpty():
        again = broadcast_if_small(again, BROADCAST_IDS)
        got = got.join(again, same, "left_anti").unionByName(got.join(again, same, "left_semi").dropDuplicates(["_id", "_sha"]))
    return got.select("_row.*")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)"""
