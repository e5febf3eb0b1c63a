"""Exact row numbers in a total order without a single-task window.

``row_number() over (order by k)`` moves every row to one task. Here the rows
are cut into range buckets on the first order key (an approximate quantile
sketch chooses the cuts; any cuts give the same answer), each bucket is
numbered by a window partitioned by bucket, and a bucket's offset comes from a
prefix over per-bucket counts (at most ``buckets`` rows per group).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import land


def hash_key(cols, seed: int | str = 42) -> tuple[Column, Column]:
    """Deterministic pseudo-random order shared with SQL engines:
    ``md5(seed || id)``. Returns (52-bit numeric prefix as double, full hex)."""
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in ([cols] if isinstance(cols, str) else cols)]
    h = F.md5(F.concat(*parts))
    num = F.conv(F.substring(h, 1, 13), 16, 10).cast("double")
    return num, h


def bucket_count(spark) -> int:
    """Range buckets to cut an order into: they grow with the session's shuffle partitions."""
    return max(256, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def row_number_by(df: DataFrame, order: list[str], by: list[str] | None = None,
                  out: str = "rn", buckets: int | None = None) -> DataFrame:
    """Add ``out`` = row_number() over (partition by ``by`` order by ``order``)
    (1-based). ``order[0]`` must be numeric or a timestamp; the rest break ties.
    Null order keys come first, null groups are a group of their own. By default
    there are as many buckets as the session has shuffle partitions (256 at least)."""
    by = list(by or [])
    buckets = buckets or bucket_count(df.sparkSession)
    rel_err = min(0.002, 0.5 / buckets)
    first = order[0]
    key = "_rk0"
    d = df.withColumn(key, F.col(first).cast("timestamp").cast("double")
                      if dict(df.dtypes)[first].startswith("timestamp") else F.col(first).cast("double"))
    qs = [i / buckets for i in range(1, buckets)]
    cuts = sorted(set(v for v in d.approxQuantile(key, qs, rel_err) if v is not None))
    splits = [-float("inf")] + (cuts or [0.0]) + [float("inf")]
    d = Bucketizer(splits=splits, inputCol=key, outputCol="_bk", handleInvalid="keep").transform(d)
    d = d.withColumn("_bk", F.coalesce("_bk", F.lit(-1.0)))  # nulls sort before all values
    cnt = d.groupBy(*by, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    pw = Window.partitionBy(*by).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    cnt = cnt.select(*by, "_bk", F.coalesce(F.sum("_c").over(pw), F.lit(0)).alias("_off"))
    w = Window.partitionBy(*by, "_bk").orderBy(*[F.col(c) for c in order])
    if by:
        other = cnt.select(*[F.col(c).alias("_by_" + c) for c in by], F.col("_bk").alias("_by_bk"), "_off")
        same = F.col("_bk") == F.col("_by_bk")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col("_by_" + c))
        d = d.join(other, same).drop("_by_bk", *["_by_" + c for c in by])
    else:
        d = d.join(F.broadcast(cnt), "_bk")
    return d.withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("bigint")).drop(
        key, "_bk", "_off")


def dense_codes(values: DataFrame, col: str, out: str = "code") -> DataFrame:
    """(col, out): the rank from 0 of every distinct non-null value of ``col`` in its order, strings by their bytes.

    The distinct values are range-partitioned by sampled split points and sorted inside their partitions; a value's
    rank is its place there plus the number of values in the partitions before (one row a partition). No task
    holds the dictionary."""
    v = F.col(f"`{col}`")
    placed = land(values.select(v.alias(col)).where(v.isNotNull()).distinct()
                  .repartitionByRange(v).sortWithinPartitions(v).withColumn("_id", F.monotonically_increasing_id()))
    run = F.shiftright("_id", 33)
    runs = placed.groupBy(run.alias("_run")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    runs = runs.select("_run", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(runs), run == F.col("_run")).select(col, (F.col("_id") - F.col("_first") + F.col("_before")).alias(out))
