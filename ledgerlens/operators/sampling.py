"""Deterministic sampling, splits, folds, class balance and scaling.

Randomness is a hash: rows are ordered by ``md5(seed || id)``, which any engine
can reproduce. Positions in an order are exact distributed row numbers
(``functions.ranking``), so no split needs a global single-task sort, and
counts per class come from one small aggregate.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import hash_key, row_number_by
from ..sources.tables import micros


def with_hash_order(df: DataFrame, id_cols, seed: int = 42) -> DataFrame:
    num, h = hash_key(id_cols, seed)
    return df.withColumn("_hnum", num).withColumn("_hhex", h)


def downsample(df: DataFrame, label: str, id_cols, ratio: int = 2, seed: int = 42) -> DataFrame:
    """L1: every positive row plus the first ``ratio x positives`` negatives in
    hash order. Raises if there are fewer negatives than that."""
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    n_pos, n_neg = counts.get(1, 0), counts.get(0, 0)
    want = ratio * n_pos
    if n_neg < want:
        raise ValueError(f"only {n_neg} negatives for {want} requested")
    neg = row_number_by(with_hash_order(df.where(F.col(label) == 0), id_cols, seed),
                        ["_hnum", "_hhex"], out="_rn")
    keep = neg.where(F.col("_rn") <= want).drop("_rn", "_hnum", "_hhex")
    return df.where(F.col(label) == 1).unionByName(keep)


def stratified_split(df: DataFrame, label: str, id_cols, test_size: float = 0.2,
                     seed: int = 42) -> DataFrame:
    """L2: per class, the first ``ceil(test_size * n_class)`` rows in hash
    order are test; adds ``is_test`` (int). Rows without a label are a class."""
    counts = df.groupBy(F.col(label).alias("_cls")).agg(F.count(F.lit(1)).alias("_nc"))
    d = row_number_by(with_hash_order(df, id_cols, seed), ["_hnum", "_hhex"], by=[label], out="_rn")
    d = d.join(counts, F.col(label).eqNullSafe(F.col("_cls"))).drop("_cls")
    return (d.withColumn("is_test", (F.col("_rn") <= F.ceil(F.col("_nc") * test_size)).cast("int"))
            .drop("_rn", "_nc", "_hnum", "_hhex"))


def _row_at(df: DataFrame, k: Column, tie: str, place: int, share: float):
    """(k, tie) of the row with this number (1-based, nulls first) in (k, tie) order, if one exists and no row with the
    same pair comes behind it. Only rows near the place are ordered: a sketch names a band and counting proves it."""
    d = df.select(k.alias("_k"), F.col(tie).alias("_tie"))
    cuts = d.select(F.col("_k").cast("double").alias("_k")).approxQuantile("_k", [max(0.0, share - 0.005), min(1.0, share + 0.005)], 0.002)
    if not cuts:
        return None
    x = F.col("_k").cast("double")
    one = d.agg(F.count_if(x.isNull() | (x < cuts[0])).alias("before"), F.count_if((x >= cuts[0]) & (x <= cuts[1])).alias("inside")).first()
    if not one["before"] < place <= one["before"] + one["inside"]:
        return None
    band = row_number_by(d.where((x >= cuts[0]) & (x <= cuts[1])), ["_k", "_tie"], out="_rn")
    two = band.where(F.col("_rn").between(place - one["before"], place - one["before"] + 1)).orderBy("_rn").collect()
    if len(two) == 2 and (two[0]["_k"], two[0]["_tie"]) == (two[1]["_k"], two[1]["_tie"]):
        return None
    return two[0]["_k"], two[0]["_tie"]


def temporal_split(df: DataFrame, ts: str = "ts", tie: str = "hash", test_size: float = 0.2) -> DataFrame:
    """L3: in (time, tie) order the first ``int(n * (1 - test_size))`` rows are
    train, the rest test; adds ``is_test``. The last training row is found first and the others are
    compared with it, so the rows are not exchanged; only if rows equal to it come behind it are all numbered."""
    n = df.count()
    cut = int(n * (1 - test_size))
    k = micros(ts) if dict(df.dtypes)[ts].startswith("timestamp") else F.col(ts)
    last = _row_at(df, k, tie, cut, cut / n) if cut else None
    if last is None:
        d = row_number_by(df, [ts, tie], out="_rn")
        return d.withColumn("is_test", (F.col("_rn") > cut).cast("int")).drop("_rn")
    at, name = last
    behind = F.coalesce(k > F.lit(at), F.lit(False))
    later = F.col(tie).isNotNull() if name is None else F.coalesce(F.col(tie) > F.lit(name), F.lit(False))
    return df.withColumn("is_test", (behind | (F.coalesce(k == F.lit(at), F.lit(False)) & later)).cast("int"))


def time_series_folds(df: DataFrame, ts: str = "ts", tie: str = "hash", n_splits: int = 5) -> DataFrame:
    """L4: expanding-window folds. With ``t = n // (k + 1)``, fold i (0-based)
    tests rows ``[n - (k - i) t, n - (k - i - 1) t)`` and trains on all rows
    before. Adds ``row_idx`` (0-based, time order) and ``test_fold`` (null for
    rows that are never tested)."""
    n = df.count()
    t = n // (n_splits + 1)
    d = row_number_by(df, [ts, tie], out="_rn").withColumn("row_idx", F.col("_rn") - 1).drop("_rn")
    first = n - n_splits * t
    fold = F.when(F.col("row_idx") >= first, F.floor((F.col("row_idx") - first) / t)).cast("int")
    return d.withColumn("test_fold", fold if t > 0 else F.lit(None).cast("int"))


def stratified_kfold(df: DataFrame, label: str, id_cols, k: int = 5, seed: int = 42) -> DataFrame:
    """Per class, rows in hash order are dealt round-robin into k folds."""
    d = row_number_by(with_hash_order(df, id_cols, seed), ["_hnum", "_hhex"], by=[label], out="_rn")
    return d.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn", "_hnum", "_hhex")


def sample_strategy(df: DataFrame, label: str, target_ratio: float = 0.5) -> DataFrame:
    """Majority keeps its count, minority target = int(majority * ratio)."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return c.agg(F.max_by(label, F.struct("n", F.col(label))).alias("majority_class"),
                  F.max("n").alias("majority_count"),
                  F.min_by(label, F.struct("n", F.col(label))).alias("minority_class"),
                  F.floor(F.max("n") * target_ratio).cast("bigint").alias("minority_target"))


def scale_pos_weight(df: DataFrame, label: str) -> DataFrame:
    """Negatives / positives (infinity when there is no positive)."""
    return df.agg(F.count_if(F.col(label) == 0).alias("n_neg"), F.count_if(F.col(label) == 1).alias("n_pos")) \
        .withColumn("scale_pos_weight", F.when(F.col("n_pos") == 0, F.lit(float("inf")))
                    .otherwise(F.col("n_neg") / F.col("n_pos")))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (k n_c) per class."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    tot = c.agg(F.sum("n_c").alias("_n"), F.count(F.lit(1)).alias("_k"))
    return c.crossJoin(F.broadcast(tot)).select(
        label, "n_c", (F.col("_n") / (F.col("_k") * F.col("n_c"))).alias("weight"))


def standard_scaler_fit(train: DataFrame, cols: list[str]) -> DataFrame:
    """L12 fit: mean and population std per column (std 0 -> 1), one row."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    return train.agg(*aggs)


def standard_scaler_apply(df: DataFrame, stats: DataFrame, cols: list[str]) -> DataFrame:
    """L12 apply: (x - mean) / std with the fitted one-row statistics."""
    d = df.crossJoin(F.broadcast(stats))
    for c in cols:
        sd = F.col(f"{c}__std")
        d = d.withColumn(c, (F.col(c) - F.col(f"{c}__mean"))
                         / F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd))
    return d.drop(*[f"{c}__mean" for c in cols], *[f"{c}__std" for c in cols])


def hash_sample(df: DataFrame, id_cols, n: int, seed: int = 42) -> DataFrame:
    """N rows in hash order (the limit is the sampling operator)."""
    num, h = hash_key(id_cols, seed)
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


# Fixed values of the adequacy gate: minimum fraud rows, minimum rows, z for
# alpha 0.05 (two-sided) and power 0.8, and the medium effect size.
MIN_FRAUD, MIN_TOTAL, Z_ALPHA, Z_BETA, EFFECT = 100, 1000, 1.96, 0.84, 0.5


def adequacy(df: DataFrame, label: str) -> DataFrame:
    """Fraud / total counts against the minimums, and the power check
    ``ceil((z_a + z_b)^2 * 2 / h^2)`` per class -> GOOD / MARGINAL / POOR."""
    need = math.ceil((Z_ALPHA + Z_BETA) ** 2 * 2 / EFFECT ** 2)
    c = df.agg(F.count(F.lit(1)).alias("n_total"), F.count_if(F.col(label) == 1).alias("n_fraud"))
    return c.select(
        "n_total", "n_fraud",
        ((F.col("n_fraud") >= MIN_FRAUD) & (F.col("n_total") >= MIN_TOTAL)).alias("adequate"),
        F.lit(need).alias("required_per_class"),
        F.when(F.col("n_fraud") >= need, F.lit("GOOD"))
        .when(F.col("n_fraud") >= need / 2, F.lit("MARGINAL")).otherwise(F.lit("POOR")).alias("power"))
