"""Extendible hashing of rows into shards below a byte limit, in DataFrame operations only.

The directory is indexed by the leading bits of a 60-bit key hash. Byte sums per
directory cell give the sums of every shorter prefix; a prefix over the limit is
split on its next bit, any other becomes a shard. Cells of the directory that are
still too large go to a further round with more bits, and only their rows do.

Rules: null text weighs 0 bytes; null keys hash alike; rows of one key hash stay
together, and a shard of one hash (a single long document, or repeats of a key)
that is over the limit is final and marked ``oversize``; an empty table has no
shards; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, landed

HASH_BITS = 60
#: Bits that a directory has beyond what an even spread needs, and bits that each later round adds.
SLACK_BITS, STEP_BITS = 3, 6
#: Directories up to this many cells are broadcast to the rows, larger ones joined by shuffle.
BROADCAST_CELLS = 500_000


def key_hash(key: str):
    """Leading 60 bits of the MD5 of the key as text (null: of the empty text)."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(h, bits):
    return F.shiftright(h, HASH_BITS - bits) if isinstance(bits, int) else F.expr(f"shiftright({h}, {HASH_BITS} - {bits})")


def directory(rows: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """cell (prefix of ``high`` bits) -> depth, bytes, oversize of its shard; depth null where it needs more bits."""
    cells = landed(rows.groupBy(prefix(F.col("h"), high).alias("cell")).agg(
        F.sum("n_bytes").alias("bytes"), F.min("h").alias("lo"), F.max("h").alias("hi")), "cells")
    by_depth = cells.select("cell", "bytes", "lo", "hi", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")) \
        .withColumn("pre", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = by_depth.groupBy("depth", "pre").agg(F.sum("bytes").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    done = sums.filter((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))) \
        .withColumn("oversize", F.col("shard_bytes") > limit).drop("lo", "hi")
    found = by_depth.select("cell", "depth", "pre").join(done, ["depth", "pre"]) \
        .groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes", "oversize")).alias("s"))
    return landed(cells.select("cell").join(found, "cell", "left").select("cell", "s.*"), "directory")


def shard(docs: DataFrame, limit_bytes: int, key: str = "doc_id", content: str = "text") -> DataFrame:
    """key, n_bytes, shard (its bits as text), depth, shard_bytes, oversize for every row."""
    rows = landed(docs.select(
        F.col(key).alias("key"), key_hash(key).alias("h"),
        F.coalesce(F.octet_length(content), F.lit(0)).cast("long").alias("n_bytes")), "sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    high = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SLACK_BITS)
    low, parts = 0, []
    while True:
        cells = directory(rows, low, high, limit_bytes)
        joined = rows.withColumn("cell", prefix(F.col("h"), high)).join(broadcast_if_small(cells, BROADCAST_CELLS), "cell")
        parts.append(joined.filter("depth is not null"))
        if cells.filter("depth is null").isEmpty():
            break
        rows = landed(joined.filter("depth is null").select("key", "h", "n_bytes"), "oversized")
        low, high = high + 1, min(HASH_BITS, high + STEP_BITS)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bits = F.expr(f"if(depth = 0, '', lpad(bin(shiftright(h, {HASH_BITS} - depth)), depth, '0'))")
    return out.select(F.col("key").alias(key), "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"),
                      "shard_bytes", "oversize")


def write_shards(docs: DataFrame, path: str, limit_bytes: int, key: str = "doc_id", content: str = "text") -> None:
    """Write ``docs`` as Parquet below ``path`` with a folder per shard, each shard by one task.

    Every key's rows share a shard, so the join is on the key.
    """
    where = shard(docs, limit_bytes, key, content).select(F.col(key).alias("_shard_key"), F.col("shard").alias("_shard")).distinct()
    docs.join(where, docs[key].eqNullSafe(where["_shard_key"])).drop("_shard_key").repartition("_shard") \
        .write.partitionBy("_shard").parquet(path)


def oracle(limit: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
x AS (SELECT d.*, CAST(r.depth AS INT) AS depth, h >> CAST({HASH_BITS} - r.depth AS INT) AS pre FROM d, range(0, {HASH_BITS + 1}) r(depth)),
s AS (SELECT depth, pre, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, min(h) = max(h) AS one FROM x GROUP BY ALL),
f AS (SELECT x.*, s.shard_bytes, row_number() OVER (PARTITION BY x.doc_id, x.h ORDER BY x.depth) AS rn
      FROM x JOIN s USING (depth, pre) WHERE s.shard_bytes <= {limit} OR s.one)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(pre), depth, '0') END AS shard, depth, shard_bytes,
       shard_bytes > {limit} AS oversize
FROM f WHERE rn = 1"""
