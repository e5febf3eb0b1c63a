"""Shared helpers: input tables, tables cut into the shared folder, Arrow text access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import checkpoint_dir

#: Bytes of text that one numpy step handles at a time (whole documents; a longer one goes alone).
SLICE_BYTES = 2 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex[:12]}-{name}"


def landed(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and
    what follows sees a plain table (which adaptive execution can split)."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    w = df.write
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def all_columns(df: DataFrame) -> list[Column]:
    """Every column by its exact name, dots and all."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a (landed) table has at most ``max_rows`` rows; reads footers only."""
    return df.count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a landed table of at most ``max_rows`` rows, else leave the join to a shuffle."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def text_slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Split a batch into runs of rows of about SLICE_BYTES of text.

    Yields (rows, bytes, offsets): UTF-8 bytes as uint8 and len(rows)+1 offsets
    into them. Null text counts as empty.
    """
    text = batch.column(batch.schema.get_field_index(column)).fill_null("").cast(pa.large_string())
    n = len(text)
    if not n:
        return
    _, off_buf, data_buf = text.buffers()
    off = np.frombuffer(off_buf, np.int64)[text.offset:text.offset + n + 1]
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(i, j - i), data[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
