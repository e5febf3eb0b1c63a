"""Token ids in one compressed file per shard: a wavelet matrix.

A shard's distinct ids are numbered by falling frequency. Level after level, one
bit of the numbers (the highest first) is written as a bit-plane, and the numbers
are stably divided, zeros before ones. Planes are cut into blocks, each compressed
by itself, with the number of ones before every block: rank and select need one
block per plane, so single tokens, counts and occurrences are read without
unpacking the shard. The shard's documents (ids, lengths) stand in front.

``write_shards`` puts the documents in doc_id order over the cluster's range
partitions and writes files to the shared folder while it streams; a task that is
run again writes files of other names, and only those that the manifest names
count. ``read_shards`` reads them as binary files.

Rules: null text is an empty document (the end id alone); a null doc_id comes first;
rows that repeat a doc_id follow each other in the order of their text; an empty
table writes no files; a document is never split over shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe
from .common import broadcast_if_small, column, landed, shared_path
from .packing import ENCODE_BYTES, row_runs

MAGIC = b"WVM1"
BLOCK_BITS = 1 << 16
SHARD_TOKENS = 1 << 19
MAX_SHARDS_BROADCAST = 50_000
SUFFIX = ".wvm"
_HEAD = struct.Struct("<4sQQIII")  # magic, tokens, documents, symbols, levels, bytes of the compressed tables
_NO_ID = np.iinfo(np.int64).min


def build(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of a shard: ids of all its documents end to end, document ids (null: the least integer) and lengths."""
    n = len(ids)
    every = np.bincount(ids) if n else np.zeros(0, np.int64)
    symbols = np.flatnonzero(every)
    counts = every[symbols]
    by_count = np.argsort(-counts, kind="stable")
    number = np.zeros(int(symbols[-1]) + 1 if n else 1, np.uint32)
    number[symbols[by_count]] = np.arange(len(symbols))
    levels = max(1, int(len(symbols) - 1).bit_length()) if n else 0
    v = number[ids].astype(np.uint16 if levels <= 16 else np.uint32)
    zstd = zstandard.ZstdCompressor(level=1)
    ones, sizes, blocks = [], [], []
    for bit in reversed(range(levels)):
        m = (v & v.dtype.type(1 << bit)) != 0
        for a in range(0, n, BLOCK_BITS):
            part = m[a:a + BLOCK_BITS]
            ones.append(int(np.count_nonzero(part)))
            blocks.append(zstd.compress(np.packbits(part).tobytes()))
            sizes.append(len(blocks[-1]))
        v = np.concatenate((np.compress(~m, v), np.compress(m, v)))
    table = zstd.compress(b"".join(np.ascontiguousarray(x).tobytes() for x in (
        doc_ids.astype("<i8"), lengths.astype("<u8"), symbols[by_count].astype("<u4"), counts[by_count].astype("<u8"),
        np.array(ones, "<u4"), np.array(sizes, "<u4"))))
    return _HEAD.pack(MAGIC, n, len(doc_ids), len(symbols), levels, len(table)) + table + b"".join(blocks)


class WaveletMatrix:
    """Reads a shard's file; the planes stay compressed."""

    def __init__(self, raw: bytes):
        magic, self.n, n_docs, n_symbols, self.levels, size = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.per_plane = -(-self.n // BLOCK_BITS)
        n_blocks = self.per_plane * self.levels
        table = zstandard.ZstdDecompressor().decompress(raw[_HEAD.size:_HEAD.size + size])
        at, parts = 0, []
        for kind, k in (("<i8", n_docs), ("<u8", n_docs), ("<u4", n_symbols), ("<u8", n_symbols), ("<u4", n_blocks), ("<u4", n_blocks)):
            parts.append(np.frombuffer(table, kind, k, at))
            at += parts[-1].nbytes
        self.doc_ids, self.lengths, self.symbols, self.counts, ones, sizes = parts
        self.raw, self.zstd = raw, zstandard.ZstdDecompressor()
        self.block_at = _HEAD.size + size + np.concatenate(([0], np.cumsum(sizes.astype(np.int64))))
        ones = ones.astype(np.int64).reshape(self.levels, self.per_plane)
        self.before = np.concatenate((np.zeros((self.levels, 1), np.int64), np.cumsum(ones, axis=1)), axis=1)
        self.zeros = self.n - self.before[:, -1]
        self.number = {int(s): i for i, s in enumerate(self.symbols)}
        self.block = lru_cache(maxsize=64)(self._block)

    def _block(self, level: int, b: int) -> np.ndarray:
        k = level * self.per_plane + b
        packed = self.zstd.decompress(self.raw[self.block_at[k]:self.block_at[k + 1]])
        return np.unpackbits(np.frombuffer(packed, np.uint8), count=min(BLOCK_BITS, self.n - b * BLOCK_BITS))

    def _ones(self, level: int, i: int) -> int:
        """Ones of a plane before position ``i``."""
        b, r = divmod(i, BLOCK_BITS)
        return int(self.before[level, b] + (np.count_nonzero(self.block(level, b)[:r]) if r else 0))

    def access(self, i: int) -> int:
        """The token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        v = 0
        for level in range(self.levels):
            bit = int(self.block(level, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._ones(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
            v = v << 1 | bit
        return int(self.symbols[v])

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where, behind the last plane, the token's run begins, and how far it reaches for positions before ``i``."""
        v, a = self.number[token], 0
        for level in range(self.levels):
            ones_a, ones_i = self._ones(level, a), self._ones(level, i)
            if v >> (self.levels - 1 - level) & 1:
                a, i = int(self.zeros[level]) + ones_a, int(self.zeros[level]) + ones_i
            else:
                a, i = a - ones_a, i - ones_i
        return a, i

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before position ``i``."""
        if token not in self.number:
            return 0
        a, b = self._range(token, i)
        return b - a

    def count(self, token: int) -> int:
        return int(self.counts[self.number[token]]) if token in self.number else 0

    def _find(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) zero or one of a plane."""
        starts = np.minimum(np.arange(self.per_plane + 1) * BLOCK_BITS, self.n)
        before = self.before[level] if bit else starts - self.before[level]
        b = int(np.searchsorted(before, k, "right")) - 1
        return b * BLOCK_BITS + int(np.flatnonzero(self.block(level, b) == bit)[k - before[b]])

    def select(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``token``."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        v, i = self.number[token], self._range(token, 0)[0] + k
        for level in reversed(range(self.levels)):
            bit = v >> (self.levels - 1 - level) & 1
            i = self._find(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def tokens(self) -> np.ndarray:
        """All ids: behind the last plane the numbers stand in runs of known length; plane by plane they go back to their places."""
        if not self.n:
            return np.zeros(0, "<u4")
        number = np.arange(len(self.symbols), dtype=np.uint16 if self.levels <= 16 else np.uint32)
        flipped = np.zeros(len(number), np.int64)
        for level in range(self.levels):
            flipped |= (number.astype(np.int64) >> level & 1) << (self.levels - 1 - level)
        runs = np.argsort(flipped, kind="stable")
        v = np.repeat(number[runs], self.counts[runs].astype(np.int64))
        for level in reversed(range(self.levels)):
            m = np.concatenate([self._block(level, b) for b in range(self.per_plane)]).view(bool)
            up = np.empty_like(v)
            up[np.flatnonzero(~m)], up[np.flatnonzero(m)] = v[:self.zeros[level]], v[self.zeros[level]:]
            v = up
        return self.symbols[v]


def _filesystem(path: str):
    """Arrow's file system for a folder of the cluster, and the path in it."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Write the shards below ``path``; returns the manifest: name, part, nth, n_tokens, start (ids of all shards before)."""
    vocabulary = vocabulary or bpe.default_vocabulary()
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = bpe.encoder(vocabulary), TaskContext.get().partitionId()
        store, folder = _filesystem(path)
        held: list[tuple[int, bytes]] = []
        size = nth = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, nth
            name = f"{part:06d}-{nth:06d}-{uuid.uuid4().hex[:8]}{SUFFIX}"
            raw = build(np.frombuffer(b"".join(b for _, b in held), "<u4"), np.array([i for i, _ in held], np.int64),
                        np.array([len(b) // 4 for _, b in held], np.int64))
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(raw)
            row = pa.RecordBatch.from_pydict({"name": [name], "part": [part], "nth": [nth], "n_tokens": [size // 4], "n_bytes": [len(raw)]},
                                             schema=pa.schema([("name", pa.string()), *((c, pa.int64()) for c in ("part", "nth", "n_tokens", "n_bytes"))]))
            held, size, nth = [], 0, nth + 1
            return row

        for batch in batches:
            ids = column(batch, "doc_id").fill_null(int(_NO_ID)).to_pylist()
            texts = column(batch, "text").fill_null("")
            for rows in row_runs(texts, ENCODE_BYTES):
                for doc, got in zip(ids[rows.start:rows.stop], enc.encode(texts.slice(rows.start, len(rows)).to_pylist())):
                    held.append((doc, got + end))
                    size += len(held[-1][1])
                    if size >= 4 * shard_tokens:
                        yield flush()
        if held:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = landed(ordered.mapInArrow(write, "name string, part long, nth long, n_tokens long, n_bytes long"), "shard-manifest")
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = made.groupBy("part").agg(F.sum("n_tokens").alias("t"))  # one row per partition
    parts = parts.select("part", F.coalesce(F.sum("t").over(ahead(Window.orderBy("part"))), F.lit(0)).alias("ahead"))
    inside = made.withColumn("inside", F.coalesce(F.sum("n_tokens").over(ahead(Window.partitionBy("part").orderBy("nth"))), F.lit(0)))
    return landed(inside.join(F.broadcast(parts), "part").select("name", "part", "nth", "n_tokens", "n_bytes",
                                                                 (F.col("ahead") + F.col("inside")).alias("start")), "shard-manifest")


def read_shards(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path) \
        .select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    named = files.join(broadcast_if_small(manifest.select("name", "start"), MAX_SHARDS_BROADCAST), "name")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, start in zip(column(batch, "content"), column(batch, "start").to_pylist()):
                w = WaveletMatrix(raw.as_py())
                ids = w.tokens().tobytes()
                ends = np.cumsum(w.lengths.astype(np.int64))
                starts = ends - w.lengths.astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([None if i == _NO_ID else i for i in w.doc_ids.tolist()], pa.int64()), pa.array(start + starts),
                     pa.array(w.lengths.astype(np.int64)),
                     pa.array([zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist())], pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return named.select("content", "start").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Write the documents' ids as shards, read the files back; one row per document."""
    spark = docs.sparkSession
    path = shared_path(spark, "shards")
    manifest = write_shards(docs, path, vocabulary, end_id)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_shards(spark, path, manifest)
