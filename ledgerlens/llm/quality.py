"""Quality rules: word and line statistics, and zstandard compression bands.

Whole text and fixed chunks of it are compressed; text that repeats itself
compresses too well, text that is noise hardly at all. Limits depend on length,
because short texts cannot compress well and long ones find more to refer to.

Rules: null text has no words; every count covers the whole text; an empty table
gives no rows; rows are judged one by one, so repeated rows agree; other columns
are not read (``keep_good`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_columns, column, text_slices
from .words import IS_SPACE, shingle_hashes, word_bounds, word_hashes

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Limits:
    """Compression bands. ``whole``: (bytes from, least ratio, largest ratio) by length of the text;
    ``chunk``: the same by length of a chunk. A text is rejected when its whole ratio leaves its
    band, or when chunks with more than ``bad_share`` of its bytes leave theirs."""

    level: int = 3
    chunk_bytes: int = 2048
    whole: tuple = ((0, 0.0, 9.0), (64, 0.45, 1.45), (128, 0.40, 1.00), (256, 0.33, 0.88), (512, 0.27, 0.80),
                    (1024, 0.22, 0.75), (4096, 0.18, 0.72), (16384, 0.14, 0.70), (65536, 0.11, 0.70))
    chunk: tuple = ((0, 0.0, 9.0), (64, 0.45, 1.45), (128, 0.38, 1.00), (256, 0.31, 0.88), (512, 0.25, 0.82), (1024, 0.21, 0.78))
    bad_share: float = 0.5


SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "whole_ratio double, bad_chunk_share double, band_ok boolean")


def _outside(ratio: np.ndarray, size: np.ndarray, bands: tuple) -> np.ndarray:
    at = np.searchsorted([b[0] for b in bands], size, "right") - 1
    return (ratio < np.array([b[1] for b in bands])[at]) | (ratio > np.array([b[2] for b in bands])[at])


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line of the text."""
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_BLANK)]
    return len(lines) - len(set(lines))


def repeat_words(h: np.ndarray, wo: np.ndarray) -> np.ndarray:
    """Per row, words inside a 3-word window that the row has at least twice."""
    win, so = shingle_hashes(h, wo, 3, short=False)
    rows = np.repeat(np.arange(len(wo) - 1), np.diff(so))
    key = win + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # windows of different rows differ
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = (wo[rows] + np.arange(len(win)) - so[rows])[twice]
    hit = np.zeros(len(h) + 3, bool)
    for i in range(3):
        hit[at + i] = True
    sums = np.concatenate(([0], np.cumsum(hit[:len(h)])))
    return sums[wo[1:]] - sums[wo[:-1]]


def compression(data: np.ndarray, limits: Limits, zstd) -> tuple[float, float, bool]:
    """(whole ratio, share of bytes in chunks outside their band, verdict); an empty text has ratio 1."""
    n, view = len(data), data.data
    if not n:
        return 1.0, 0.0, True
    whole = len(zstd.compress(view)) / n
    starts = np.arange(0, n, limits.chunk_bytes)
    size = np.minimum(limits.chunk_bytes, n - starts)
    ratio = np.array([len(zstd.compress(view[a:a + limits.chunk_bytes])) for a in starts.tolist()]) / size if len(starts) > 1 else np.array([whole])
    bad = float(size[_outside(ratio, size, limits.chunk)].sum() / n)
    return whole, bad, not bool(_outside(np.array([whole]), np.array([n]), limits.whole)[0]) and bad <= limits.bad_share


def statistics(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The columns of ``docs`` followed by those of SCHEMA."""
    from pyspark.sql.types import StructType

    extra = StructType.fromDDL(SCHEMA)
    out_schema = StructType(docs.schema.fields + extra.fields)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=limits.level)
        for batch in batches:
            for rows, data, off in text_slices(batch):
                starts, ends, wo = word_bounds(data, off)
                h = word_hashes(data, starts, ends)
                visible = ((data & 0xC0) != 0x80) & ~IS_SPACE[data]
                symbol = SYMBOL[data]
                spans = list(zip(off[:-1].tolist(), off[1:].tolist()))
                got = [compression(data[a:b], limits, zstd) for a, b in spans]
                lines = [dup_lines(t) if t else 0 for t in column(rows, "text").to_pylist()]
                counts = [np.diff(wo), np.array([np.count_nonzero(visible[a:b]) for a, b in spans]),
                          np.array([np.count_nonzero(symbol[a:b]) for a, b in spans]), np.array(lines), repeat_words(h, wo)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *(pa.array(c.astype(np.int64)) for c in counts), pa.array([g[0] for g in got]),
                     pa.array([g[1] for g in got]), pa.array([g[2] for g in got])],
                    names=[f.name for f in out_schema.fields])

    return docs.mapInArrow(judge, out_schema)


def base_failed() -> F.Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def quality(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and the compression figures of every row."""
    s = statistics(docs.select("doc_id", F.col("text").cast("string").alias("text")), limits).drop("text")
    return s.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                    base_failed().alias("base_failed"), (~base_failed() & F.col("band_ok")).alias("kept"),
                    "whole_ratio", "bad_chunk_share")


def keep_good(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    inner = docs.select(F.struct(*all_columns(docs)).alias("_row"), F.col("text").cast("string").alias("text"))
    return statistics(inner, limits).filter(~base_failed() & F.col("band_ok")).select("_row.*")
