"""Mixing sources to target weights by hash-threshold histograms.

A source's target is its weighted share of all words, at most ``max_repeats``
times its own words; what is cut off is shared again by weight (the level where
all shares fit is found from sums in the order of cap per weight). The target is
whole copies of the source plus a rest. The rest is a threshold on a 60-bit hash
of the key: words are summed by source and leading hash bits, running sums show
the bucket in which the rest ends, and only that bucket's rows are summed again
by the next bits, until one hash value is left. Rows then pass a plain filter.
Thresholds are nested: a larger budget takes a superset. Nothing is sorted but
the buckets (at most 4096 a source) and the sources themselves.

Rules: null or empty text has no words; a null source is a source, last in
order; rows that share a key share its fate; an empty table gives no rows;
the row at the threshold is taken if that brings the source nearer its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import all_columns, broadcast_if_small, landed
from .sharding import HASH_BITS, key_hash

WORD = r"[^\x20\x09-\x0D]+"
STEP_BITS = 12
BROADCAST_SOURCES = 100_000


def n_words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple[float, ...], share: float, max_repeats: int) -> DataFrame:
    """source, source_size, target from rows (source, size)."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    whole = Window.partitionBy()
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    s = s.withColumn("cap", max_repeats * F.col("source_size"))
    s = s.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), zero))
                     / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), zero)))
    free = F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))
    s = s.withColumn("final", F.min(free).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("final") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with ``copies`` (whole copies of the source) and ``below`` (hashes under it are taken once more)."""
    t = targets.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")) \
        .withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")) \
        .withColumn("head", F.lit(0).cast("long")).withColumn("sum_below", F.lit(0).cast("long")) \
        .withColumn("sum_with", F.col("source_size")).withColumn("one", F.lit(False))
    t = landed(t, "mix-targets")
    bits = 0
    run = Window.partitionBy("source").orderBy("bucket")
    while bits < HASH_BITS and not t.filter("source_size > 0 and not one").isEmpty():
        bits += STEP_BITS
        side = broadcast_if_small(t.filter("source_size > 0 and not one").select(F.col("source").alias("s"), "rest", "head", "sum_below"), BROADCAST_SOURCES)
        inside = rows.join(side, F.col("source").eqNullSafe(F.col("s"))
                           & (F.shiftright("h", HASH_BITS - bits + STEP_BITS) == F.col("head")))
        hist = inside.groupBy("source", "rest", "sum_below", F.shiftright("h", HASH_BITS - bits).alias("bucket")) \
            .agg(F.sum("size").alias("words"), (F.min("h") == F.max("h")).alias("one"), F.min("h").alias("h"))
        hist = hist.withColumn("with", F.col("sum_below") + F.sum("words").over(run)).withColumn("under", F.col("with") - F.col("words"))
        edge = hist.filter((F.col("under") <= F.col("rest")) & (F.col("rest") < F.col("with"))) \
            .select(F.col("source").alias("s"), F.when(F.col("one"), F.col("h")).otherwise(F.col("bucket")).alias("head2"),
                    F.col("under").alias("below2"), F.col("with").alias("with2"), F.col("one").alias("one2"))
        t = landed(t.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source", "source_size", "target", "copies", "rest", F.coalesce("head2", "head").alias("head"),
            F.coalesce("below2", "sum_below").alias("sum_below"), F.coalesce("with2", "sum_with").alias("sum_with"),
            F.coalesce("one2", "one").alias("one")), "mix-thresholds")
    nearer = 2 * F.col("rest") > F.col("sum_below") + F.col("sum_with")
    return t.select("source", "source_size", "target", "copies",
                    F.when(F.col("source_size") > 0, F.col("head") + F.when(nearer, 1).otherwise(0)).otherwise(0).alias("below"))


def mix_plan(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeats: int = 3,
             key: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """(rows: key, source, size, h; plan: one row per source)."""
    rows = landed(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"),
                              n_words(text).alias("size"), key_hash(key).alias("h")), "mix-rows")
    return rows, thresholds(rows, source_targets(rows, tuple(weights), share, max_repeats))


def with_copies(rows: DataFrame, plan: DataFrame, source: str, h: str) -> DataFrame:
    """Add _mix_size, _mix_target and _mix_copies, the number of times each row is taken."""
    side = broadcast_if_small(plan.select(F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_size"),
                                          F.col("target").alias("_mix_target"), "copies", "below"), BROADCAST_SOURCES)
    return rows.join(side, F.col(source).cast("string").eqNullSafe(F.col("_mix_source"))) \
        .withColumn("_mix_copies", F.col("copies") + F.when(F.col(h) < F.col("below"), 1).otherwise(0)) \
        .drop("_mix_source", "copies", "below")


def mix(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (words taken, repeats counted)."""
    rows, plan = mix_plan(docs, weights, share, max_repeats)
    out = with_copies(rows, plan, "source", "h")
    return out.select(F.col("key").alias("doc_id"), "source", "size", F.col("_mix_size").alias("source_size"),
                      F.col("_mix_target").alias("target"), F.col("_mix_copies").alias("copies"),
                      (F.col("size") * F.col("_mix_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights=(1, 2, 3), share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    _, plan = mix_plan(docs, weights, share, max_repeats)
    inner = docs.select(F.struct(*all_columns(docs)).alias("_mix_row"), F.col("source").cast("string").alias("_mix_src"),
                        key_hash("doc_id").alias("_mix_h"))
    return with_copies(inner, plan, "_mix_src", "_mix_h").filter("_mix_copies > 0") \
        .select("_mix_row", F.explode(F.sequence(F.lit(1), F.col("_mix_copies")))).select("_mix_row.*")


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
                  CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
l AS (SELECT *, 3 * source_size AS cap,
             CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER r, 0) AS DOUBLE)
             / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER r, 0) AS DOUBLE) AS level
      FROM s WINDOW r AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT coalesce(arg_min(level, cap / weight) FILTER (level * weight < cap), NULL) AS final FROM l),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(final * weight, CAST(cap AS DOUBLE))) AS target FROM l, f),
q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS copies FROM t),
c AS (SELECT d.*, q.source_size, q.target, q.copies, q.target - q.copies * q.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h) AS up_to,
             sum(size) OVER (PARTITION BY d.source, h) AS same
      FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
k AS (SELECT *, copies + CASE WHEN up_to <= rest OR (up_to - same <= rest AND 2 * rest > up_to - same + up_to) THEN 1 ELSE 0 END AS n FROM c)
SELECT doc_id, source, size, source_size, target, n AS copies, CAST(size * n AS BIGINT) AS taken FROM k"""
