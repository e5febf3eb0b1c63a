"""Registered queries for sampling, splits, folds and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rules as R
from ..operators import sampling as L
from ..sources.tables import scam_seed, tx_view
from .registry import register, with_tx

LAB_SQL = """
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
lt AS (SELECT tx.*, CASE WHEN from_addr IN (SELECT address FROM scam)
                          OR to_addr IN (SELECT address FROM scam) THEN 1 ELSE 0 END AS is_fraud,
              md5(concat('42', hash)) AS h FROM tx)"""


def labelled(spark, sf):
    tx = tx_view(spark, sf)
    return R.known_scam_labels(tx, scam_seed(tx), out="is_fraud")


@register("downsample", with_tx(LAB_SQL + """,
neg AS (SELECT hash, is_fraud, row_number() OVER (ORDER BY h) AS rn FROM lt WHERE is_fraud = 0)
SELECT hash, is_fraud FROM lt WHERE is_fraud = 1
UNION ALL
SELECT hash, is_fraud FROM neg WHERE rn <= 2 * (SELECT count(*) FROM lt WHERE is_fraud = 1)"""))
def q_downsample(spark, sf):
    """L1: all fraud plus twice as many normals in hash order."""
    return L.downsample(labelled(spark, sf), "is_fraud", "hash").select("hash", "is_fraud")


@register("stratified_split", with_tx(LAB_SQL + """
SELECT hash, is_fraud,
       CAST(row_number() OVER (PARTITION BY is_fraud ORDER BY h)
            <= ceil(count(*) OVER (PARTITION BY is_fraud) * 0.2) AS INTEGER) AS is_test
FROM lt"""))
def q_strat_split(spark, sf):
    """L2: stratified 80/20 split."""
    return L.stratified_split(labelled(spark, sf), "is_fraud", "hash").select("hash", "is_fraud", "is_test")


@register("temporal_split", with_tx("""
SELECT hash, CAST(row_number() OVER (ORDER BY ts, hash) > CAST(floor((SELECT count(*) FROM tx) * 0.8) AS BIGINT)
                  AS INTEGER) AS is_test
FROM tx"""))
def q_temporal_split(spark, sf):
    """L3: first 80 % in time order train, rest test."""
    return L.temporal_split(tx_view(spark, sf)).select("hash", "is_test")


@register("time_series_folds", with_tx("""
n AS (SELECT count(*) AS n, count(*) // 6 AS t FROM tx),
r AS (SELECT hash, row_number() OVER (ORDER BY ts, hash) - 1 AS row_idx FROM tx)
SELECT hash, row_idx,
       coalesce(CASE WHEN row_idx >= n - 5 * t THEN CAST(floor((row_idx - (n - 5 * t)) / t) AS INTEGER) END, -1)
         AS test_fold
FROM r, n"""))
def q_ts_folds(spark, sf):
    """L4: five expanding time-series folds."""
    d = L.time_series_folds(tx_view(spark, sf))
    return d.select("hash", "row_idx", F.coalesce(F.col("test_fold"), F.lit(-1)).alias("test_fold"))


@register("stratified_kfold", with_tx(LAB_SQL + """
SELECT hash, is_fraud, CAST((row_number() OVER (PARTITION BY is_fraud ORDER BY h) - 1) % 5 AS INTEGER) AS fold
FROM lt"""))
def q_kfold(spark, sf):
    """Stratified 5-fold assignment in hash order."""
    return L.stratified_kfold(labelled(spark, sf), "is_fraud", "hash").select("hash", "is_fraud", "fold")


@register("sample_strategy", with_tx(LAB_SQL + """,
c AS (SELECT is_fraud, count(*) AS n FROM lt GROUP BY is_fraud)
SELECT arg_max(is_fraud, n) AS majority_class, max(n) AS majority_count, arg_min(is_fraud, n) AS minority_class,
       CAST(floor(max(n) * 0.5) AS BIGINT) AS minority_target FROM c"""))
def q_strategy(spark, sf):
    """Target counts for a 0.5 minority ratio."""
    return L.sample_strategy(labelled(spark, sf), "is_fraud", 0.5)


@register("scale_pos_weight", with_tx(LAB_SQL + """
SELECT count(CASE WHEN is_fraud = 0 THEN 1 END) AS n_neg, count(CASE WHEN is_fraud = 1 THEN 1 END) AS n_pos,
       round(CAST(count(CASE WHEN is_fraud = 0 THEN 1 END) AS DOUBLE)
             / count(CASE WHEN is_fraud = 1 THEN 1 END), 6) AS scale_pos_weight
FROM lt"""))
def q_spw(spark, sf):
    """Negative / positive ratio."""
    return L.scale_pos_weight(labelled(spark, sf), "is_fraud")


@register("class_weights", with_tx(LAB_SQL + """,
c AS (SELECT is_fraud, count(*) AS n_c FROM lt GROUP BY is_fraud)
SELECT is_fraud, n_c, round(CAST((SELECT sum(n_c) FROM c) AS DOUBLE) / ((SELECT count(*) FROM c) * n_c), 6) AS weight
FROM c"""))
def q_class_weights(spark, sf):
    """Balanced class weights."""
    return L.class_weights(labelled(spark, sf), "is_fraud")


@register("standard_scaling", with_tx("""
r AS (SELECT tx.*, row_number() OVER (ORDER BY ts, hash) > CAST(floor((SELECT count(*) FROM tx) * 0.8) AS BIGINT)
                   AS is_test FROM tx),
st AS (SELECT avg(value_eth) AS vm, stddev_pop(value_eth) AS vs, avg(gas_price) AS gm, stddev_pop(gas_price) AS gs
       FROM r WHERE NOT is_test)
SELECT hash, round((value_eth - vm) / CASE WHEN vs IS NULL OR vs = 0 THEN 1.0 ELSE vs END, 6) AS value_eth,
       round((gas_price - gm) / CASE WHEN gs IS NULL OR gs = 0 THEN 1.0 ELSE gs END, 6) AS gas_price
FROM r, st WHERE is_test"""))
def q_scaling(spark, sf):
    """Population-std scaling fitted on the temporal train split, applied to test."""
    d = L.temporal_split(tx_view(spark, sf))
    cols = ["value_eth", "gas_price"]
    stats = L.standard_scaler_fit(d.where(F.col("is_test") == 0), cols)
    test = d.where(F.col("is_test") == 1).withColumn("gas_price", F.col("gas_price").cast("double"))
    return L.standard_scaler_apply(test, stats, cols).select("hash", "value_eth", "gas_price")


@register("hash_sample", with_tx("""
SELECT hash, from_addr FROM tx ORDER BY md5(concat('42', hash)) LIMIT 500"""))
def q_hash_sample(spark, sf):
    """500 rows in hash order."""
    return L.hash_sample(tx_view(spark, sf), "hash", 500).select("hash", "from_addr")


@register("adequacy", with_tx(LAB_SQL + """
SELECT count(*) AS n_total, count(CASE WHEN is_fraud = 1 THEN 1 END) AS n_fraud,
       count(CASE WHEN is_fraud = 1 THEN 1 END) >= 100 AND count(*) >= 1000 AS adequate,
       63 AS required_per_class,
       CASE WHEN count(CASE WHEN is_fraud = 1 THEN 1 END) >= 63 THEN 'GOOD'
            WHEN count(CASE WHEN is_fraud = 1 THEN 1 END) >= 31.5 THEN 'MARGINAL' ELSE 'POOR' END AS power
FROM lt"""))
def q_adequacy(spark, sf):
    """Data adequacy gate and power check."""
    return L.adequacy(labelled(spark, sf), "is_fraud")
