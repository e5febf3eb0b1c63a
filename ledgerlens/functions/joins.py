"""Joining per-key values back to rows when a key may hold a third of them.

An aggregate joined back to its rows sends all rows of a key to one task, and
adaptive execution does not split such a join (an aggregate stands between the
exchange and the join). Here the few keys above 1/``HEAVY_PARTS`` of all rows are
broadcast - there are fewer than ``HEAVY_PARTS`` of them, whatever the data - and
their rows, like rows without a key, get a spread partner key that matches
nothing, so the shuffle join deals them evenly.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from .windows import busy_keys, cell_bound, dealt, row_counts

HEAVY_PARTS = 1000
#: Keys that a broadcast may hold: a per-key table of at most so many rows needs no shuffle of the rows.
BROADCAST_KEYS = 100_000


def land(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint directory and read back: what is read by an aggregate
    and again by the join of its result is computed once, and lineage ends here."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _zero(key: str):
    """0 for every row, in a form that is not folded: a literal would stop being a join key."""
    return F.pmod(F.xxhash64(key), F.lit(1)).cast("int")


def join_back(rows: DataFrame, per_key: DataFrame, key: str, count: str, spread_by: list[str],
              broadcast_keys: int = 0) -> DataFrame:
    """``rows`` with the columns of ``per_key`` (one row per key; ``count`` holds the
    key's number of rows; checkpointed here), null where the key is null. ``spread_by``: columns of
    ``rows`` whose hash deals heavy and null keys. A table of at most ``broadcast_keys`` keys is broadcast
    whole and the rows stay where they are."""
    values = [c for c in per_key.columns if c != key]
    checkpoint_dir(per_key.sparkSession)
    per_key = per_key.checkpoint()  # read three times below
    one = per_key.agg(F.sum(count).alias("total"), F.count(F.lit(1)).alias("keys")).first()
    total = one["total"] or 0
    if one["keys"] <= broadcast_keys:
        side = per_key.where(F.col(key).isNotNull()).select(F.col(key).alias("_jb_key"), F.struct(*values).alias("_jb_light"))
        d = rows.join(F.broadcast(side), F.col(key) == F.col("_jb_key"), "left")
        return d.select(*rows.columns, *[F.col("_jb_light")[c].alias(c) for c in values])
    heavy = per_key.where(F.col(count) * HEAVY_PARTS > total).select(
        F.col(key).alias("_jb_hkey"), F.struct(*values).alias("_jb_heavy"))
    light = per_key.where(F.col(count) * HEAVY_PARTS <= total).select(
        F.col(key).alias("_jb_key"), _zero(key).alias("_jb_salt"), F.struct(*values).alias("_jb_light"))
    d = rows.join(F.broadcast(heavy), F.col(key) == F.col("_jb_hkey"), "left").drop("_jb_hkey")
    alone = F.col("_jb_heavy").isNotNull() | F.col(key).isNull()
    d = d.withColumn("_jb_k", F.when(~alone, F.col(key))) \
        .withColumn("_jb_s", F.when(alone, F.pmod(F.xxhash64(*spread_by), F.lit(100_000)) + 1).otherwise(0).cast("int"))
    d = d.join(light, (F.col("_jb_k").eqNullSafe(F.col("_jb_key"))) & (F.col("_jb_s") == F.col("_jb_salt")), "left")
    out = [F.coalesce(F.col("_jb_heavy")[c], F.col("_jb_light")[c]).alias(c) for c in values]
    return d.select(*rows.columns, *out)


def window_totals(d: DataFrame, keys: list[str], totals: dict, distinct: dict[str, str]) -> DataFrame:
    """``totals`` (plain aggregates by name) and numbers of ``distinct`` non-null values (name -> column) of each group
    of ``keys`` beside its rows: windows without an exchange if the rows lie by ``keys`` or a part of these (``dealt``)."""
    w = Window.partitionBy(*keys)
    for i, c in enumerate(distinct.values()):
        place = F.row_number().over(Window.partitionBy(*keys, c).orderBy(c))
        d = d.withColumn(f"_new{i}", ((place == 1) & F.col(c).isNotNull()).cast("bigint"))
    return d.withColumns({**{name: F.sum(f"_new{i}").over(w) for i, name in enumerate(distinct)},
                          **{name: a.over(w) for name, a in totals.items()}}).drop(*[f"_new{i}" for i in range(len(distinct))])


def beside_totals(rows: DataFrame, base: DataFrame, key: str, totals: dict, distinct: dict[str, str], spread_by: list[str],
                  by_key: bool = False) -> DataFrame:
    """``rows`` with ``totals`` and numbers of ``distinct`` values of each key, null where the key is null: one exchange of
    the rows, no aggregate is joined back. ``base``: a plain table with the same rows, which the sizes of the keys are taken from.
    Keys with more rows than a task should hold are aggregated apart and broadcast (fewer than rows / bound); their rows, like
    those without a key, are dealt evenly. ``by_key``: rows with a key lie by it already, so that where neither kind is
    there they are not exchanged at all."""
    names = [*distinct, *totals]
    bound, most = cell_bound(base, key)
    n, none = row_counts(base, key)
    if most <= bound and not none:
        return window_totals(rows if by_key else dealt(rows, n, key), [key], totals, distinct)
    alone = F.col(key).isNull()
    d = rows
    if most > bound:
        checkpoint_dir(base.sparkSession)
        busy = F.broadcast(busy_keys(base, key, bound).checkpoint())
        per = base.join(busy, key, "left_semi").groupBy(key).agg(
            *[F.count_distinct(c).alias(name) for name, c in distinct.items()], *[a.alias(name) for name, a in totals.items()])
        per = per.select(F.col(key).alias("_bt_key"), F.struct(*names).alias("_bt")).checkpoint()
        d = d.join(F.broadcast(per), F.col(key) == F.col("_bt_key"), "left").drop("_bt_key")
        alone = alone | F.col("_bt").isNotNull()
    d = d.withColumn("_bt_s", F.when(alone, F.pmod(F.xxhash64(*spread_by), F.lit(100_000)) + 1).otherwise(0).cast("int"))
    d = window_totals(dealt(d, n, key, "_bt_s"), [key, "_bt_s"], totals, distinct)
    own = {name: F.when(F.col("_bt_s") == 0, F.col(name)) for name in names}
    if most > bound:
        own = {name: F.when(F.col("_bt").isNotNull(), F.col("_bt")[name]).otherwise(own[name]) for name in names}
    return d.withColumns(own).drop("_bt", "_bt_s")


def lookup(rows: DataFrame, side: DataFrame, key: str, spread_by: list[str]) -> DataFrame:
    """Left join to ``side`` (one row per key, first column ``key``) where only null keys are hot:
    they are dealt evenly. A hot non-null key is split by adaptive execution if ``side`` is a plain table."""
    side_key = "_lk_" + key
    s = side.withColumnRenamed(key, side_key).withColumn("_lk_salt", _zero(side_key))
    d = rows.withColumn("_lk_s", F.when(F.col(key).isNull(), F.pmod(F.xxhash64(*spread_by), F.lit(100_000)) + 1)
                        .otherwise(0).cast("int"))
    return d.join(s, F.col(key).eqNullSafe(F.col(side_key)) & (F.col("_lk_s") == F.col("_lk_salt")), "left") \
        .drop(side_key, "_lk_salt", "_lk_s")
