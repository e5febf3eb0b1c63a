"""Readers for the landed tables and the transaction views built over them.

The engine works on one transaction table with the columns below; on the test
data it is a view over ``lineitem`` joined to ``orders`` (customer and part keys
share one address space, so addresses both send and receive).

    hash string, block_number bigint, tx_index int, from_addr bigint,
    to_addr bigint, value_eth double, gas bigint, gas_price bigint,
    nonce int, is_error int, ts timestamp_ntz
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import TASK_ROWS, dealt

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")

# Total order of a sender's transactions: time, then block position, then hash.
TX_ORDER = ("ts", "block_number", "tx_index", "hash")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


_LANDED: dict = {}


def tx_view(spark: SparkSession, sf_dir: str, land: bool = True) -> DataFrame:
    """The transaction table. Operators run over many passes (statistics, then
    rows), so the view is *landed* once per session as Parquet in the shared
    checkpoint directory and read back: later passes are column-pruned scans,
    as they would be over the landed transaction table in production, instead
    of re-running the join. ``land=False`` returns the plain view."""
    if not land:
        return tx_join(spark, sf_dir)
    from ..session import checkpoint_dir
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir))
    path = _LANDED.get(key)
    if path is None:
        tag = hashlib.md5(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
        path = checkpoint_dir(spark).rstrip("/") + f"/landed/tx_{tag}"
        tx_join(spark, sf_dir).write.mode("overwrite").parquet(path)
        _LANDED[key] = path
    return spark.read.parquet(path)


def tx_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions: one row per line item, sender = customer, receiver = part.

    The join is on the order key; at scale both sides are large and Spark
    sort-merges them (or co-locates them when the tables are bucketed by key).
    Only the columns used here are read (pruned at the Parquet scan).
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount",
        "l_extendedprice", "l_quantity", "l_returnflag")
    od = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    n = li.count()  # from the files' footers
    if -(-n // TASK_ROWS) > int(spark.conf.get("spark.sql.shuffle.partitions", "200")):  # sorts of the join fit into a task
        li, od = dealt(li, n, "l_orderkey"), dealt(od, n, "o_orderkey")
    j = li.join(od, li.l_orderkey == od.o_orderkey)
    return j.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("hash"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        .cast("bigint").alias("block_number"),
        F.col("l_linenumber").alias("tx_index"),
        F.col("o_custkey").alias("from_addr"),
        F.col("l_partkey").alias("to_addr"),
        F.when(F.col("l_discount") == 0, F.lit(0.0))
        .otherwise(F.col("l_extendedprice") / 1000).alias("value_eth"),
        (F.lit(21000) + F.col("l_quantity").cast("bigint") * 100).alias("gas"),
        (F.lit(1000000000) + ((F.col("l_suppkey") * 7919 + F.col("l_partkey")) % 1000)
         * 1000000).alias("gas_price"),
        F.col("l_linenumber").alias("nonce"),
        (F.col("l_returnflag") == "R").cast("int").alias("is_error"),
        (F.col("o_orderdate") + F.make_dt_interval(
            F.lit(0), F.lit(0), F.lit(0), ((F.col("l_partkey") * 37) % 3600).cast("decimal(18,6)")))
        .alias("ts"),
    )


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secondary transaction view with microsecond timestamps (time features)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").cast("string").alias("hash"),
        F.lit(0).cast("bigint").alias("block_number"),
        F.lit(0).alias("tx_index"),
        F.col("user_id").alias("from_addr"),
        F.col("event_type").alias("to_addr"),
        F.col("value").alias("value_eth"),
        F.lit(21000).cast("bigint").alias("gas"),
        F.lit(1000000000).cast("bigint").alias("gas_price"),
        F.lit(0).alias("nonce"),
        (F.col("event_type") == "error").cast("int").alias("is_error"),
        F.col("ts"),
    )


def scam_seed(tx: DataFrame, modulus: int = 97) -> DataFrame:
    """Known-bad address set for the test data: senders with ``addr % 97 = 0``."""
    return (tx.select(F.col("from_addr").alias("address"))
            .where((F.col("address") % modulus) == 0).distinct())


def micros(ts: str | Column) -> Column:
    """Epoch microseconds of a (naive, UTC) timestamp column."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))
