"""Registered queries for the rule operators."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import rules as R
from ..sources.tables import scam_seed, tx_view
from .registry import TX_CTE, register, with_tx


def drainer_sql(p: R.RuleParams) -> str:
    """DuckDB CTEs ``q``, ``s``, ``h2``, ``per`` and ``flags`` for W1-W6."""
    win = p.zero_window_s * 1_000_000
    if p.high_value_q is not None:
        qsel = (f"quantile_cont(value_eth, {p.high_value_q}) AS v_hi, "
                f"quantile_cont(gas_price, {p.low_gas_q}) AS g_lo, ")
        w2 = "q.v_max > 0 AND value_eth > q.v_hi AND gas_price < q.g_lo"
    else:
        qsel = ""
        w2 = (f"value_eth >= {p.min_value_eth} AND gas_price / 1e9 <= {p.max_gas_price_gwei} "
              f"AND value_eth / (gas * gas_price / 1e18) >= {p.min_value_to_gas}")
    if p.follower_q is not None:
        qsel += f"quantile_cont(value_eth, {p.follower_q}) AS v_follow, "
        hit = "fmax > q.v_follow"
    else:
        hit = f"fmax >= {p.follower_min_value}"
    w5 = f"dnonce > {p.nonce_jump}"
    if p.nonce_window_s is not None:
        w5 += f" AND gap_us / 1e6 <= {p.nonce_window_s}"
    return f"""
q AS (SELECT {qsel} max(value_eth) AS v_max FROM tx),
s AS (SELECT tx.*, epoch_us(ts) AS t,
             epoch_us(ts) - lag(epoch_us(ts)) OVER w AS gap_us,
             nonce - lag(nonce) OVER w AS dnonce
      FROM tx WHERE from_addr IS NOT NULL
      WINDOW w AS (PARTITION BY from_addr ORDER BY ts, block_number, tx_index, hash)),
f AS (SELECT s.*, max(value_eth) OVER (PARTITION BY from_addr ORDER BY t
              RANGE BETWEEN 1 FOLLOWING AND {win} FOLLOWING) AS fmax FROM s),
h AS (SELECT f.*, CASE WHEN value_eth = 0 AND {hit} THEN 1 ELSE 0 END AS hit FROM f, q),
h2 AS (SELECT h.*, greatest(hit, coalesce(max(hit) OVER (PARTITION BY from_addr ORDER BY t
              RANGE BETWEEN {win} PRECEDING AND 1 PRECEDING), 0)) AS w4 FROM h),
per AS (SELECT from_addr, count(*) AS n,
               count(CASE WHEN gap_us < {int(p.burst_gap_s * 1_000_000)} THEN 1 END) AS rapid,
               count(DISTINCT to_addr) AS nto
        FROM s GROUP BY from_addr),
flags AS (
  SELECT h2.*, per.n AS sender_rows,
         CASE WHEN per.n >= {p.burst_min_tx} AND per.rapid >= {p.burst_min_rapid} THEN 1 ELSE 0 END AS w1_burst,
         CASE WHEN {w2} THEN 1 ELSE 0 END AS w2_value_gas,
         CASE WHEN per.n >= {p.fanout_min_tx} AND per.nto >= per.n * {p.fanout_ratio} THEN 1 ELSE 0 END AS w3_fanout,
         w4 AS w4_zero_drain,
         CASE WHEN {w5} THEN 1 ELSE 0 END AS w5_nonce_jump
  FROM h2 JOIN per USING (from_addr) CROSS JOIN q),
flagged AS (SELECT flags.*, greatest(w1_burst, w2_value_gas, w3_fanout, w4_zero_drain, w5_nonce_jump)
                   AS suspected_drainer FROM flags)"""


ANOMALY_SQL = """
aq AS (SELECT quantile_cont(value_eth, 0.98) AS v98, quantile_cont(value_eth, 0.02) AS v02,
              avg(gas_price) AS gm, stddev_samp(gas_price) AS gs FROM flagged),
scored AS (
  SELECT flagged.*,
         CASE WHEN value_eth > v98 OR value_eth < v02 THEN 1 ELSE 0 END AS w7_extreme_value,
         CASE WHEN gs > 0 AND abs((gas_price - gm) / gs) > 3 THEN 1 ELSE 0 END AS w8_gas_outlier,
         CASE WHEN sender_rows > 10 THEN 1 ELSE 0 END AS w9_busy_sender,
         CASE WHEN value_eth = 0 THEN 1 ELSE 0 END AS w10_zero_value
  FROM flagged CROSS JOIN aq),
scored2 AS (SELECT scored.*, CAST(w7_extreme_value + w8_gas_outlier + w9_busy_sender + w10_zero_value
                   + 3 * suspected_drainer AS INTEGER) AS anomaly_score FROM scored),
thr AS (SELECT quantile_cont(anomaly_score, 0.95) AS thr FROM scored2),
labelled AS (SELECT scored2.*, CASE WHEN anomaly_score >= thr THEN 1 ELSE 0 END AS is_fraud_synthetic
             FROM scored2 CROSS JOIN thr)"""

SCAM_SQL = """
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
known AS (SELECT labelled.*,
                 CASE WHEN from_addr IN (SELECT address FROM scam)
                        OR to_addr IN (SELECT address FROM scam) THEN 1 ELSE 0 END AS is_fraud_known
          FROM labelled),
nk AS (SELECT sum(is_fraud_known) AS n_known FROM known),
policy AS (SELECT known.*, CASE WHEN coalesce(n_known, 0) = 0 THEN is_fraud_synthetic
                                ELSE is_fraud_known END AS is_fraud
           FROM known CROSS JOIN nk)"""

FLAG_OUT = "hash, from_addr, to_addr, w1_burst, w2_value_gas, w3_fanout, w4_zero_drain, w5_nonce_jump, suspected_drainer"


def _flag_cols(df):
    return df.select("hash", "from_addr", "to_addr", *R.FLAG_COLS, "suspected_drainer")


@register("drainer_flags", with_tx(drainer_sql(R.RuleParams.coded()) + f"\nSELECT {FLAG_OUT} FROM flagged"))
def q_drainer_flags(spark, sf):
    """W1-W6 per transaction, coded thresholds."""
    return _flag_cols(R.detect_drainers(tx_view(spark, sf)))


# Twenty receivers and a lower ratio, so that the fan-out rule has both outcomes on the test data.
FEW_RECEIVERS = TX_CTE.replace("l_partkey AS to_addr", "l_partkey % 20 AS to_addr")
FEW_PARAMS = replace(R.RuleParams.coded(), fanout_ratio=0.45)


@register("drainer_few_receivers", with_tx(drainer_sql(FEW_PARAMS) + "," + ANOMALY_SQL + f"""
SELECT {FLAG_OUT}, sender_rows, anomaly_score, is_fraud_synthetic FROM labelled""", FEW_RECEIVERS))
def q_drainer_few_receivers(spark, sf):
    """W1-W12 where the fan-out flag, and with it the drainer flag and the score, differ between senders."""
    tx = tx_view(spark, sf).withColumn("to_addr", F.col("to_addr") % 20)
    d = R.threshold_labels(R.anomaly_score(R.detect_drainers(tx, FEW_PARAMS)))
    return d.select("hash", "from_addr", "to_addr", *R.FLAG_COLS, "suspected_drainer", "sender_rows", "anomaly_score", "is_fraud_synthetic")


@register("drainer_summary", with_tx(drainer_sql(R.RuleParams.coded()) + """
SELECT count(*) AS n_rows, CAST(sum(w1_burst) AS BIGINT) AS n_w1_burst,
       CAST(sum(w2_value_gas) AS BIGINT) AS n_w2_value_gas, CAST(sum(w3_fanout) AS BIGINT) AS n_w3_fanout,
       CAST(sum(w4_zero_drain) AS BIGINT) AS n_w4_zero_drain, CAST(sum(w5_nonce_jump) AS BIGINT) AS n_w5_nonce_jump,
       CAST(sum(suspected_drainer) AS BIGINT) AS n_drainer, round(avg(suspected_drainer), 6) AS drainer_rate
FROM flagged"""))
def q_drainer_summary(spark, sf):
    """Detected count and rate."""
    return R.drainer_summary(R.detect_drainers(tx_view(spark, sf)))


@register("drainer_by_sender", with_tx(drainer_sql(R.RuleParams.coded()) + """
SELECT from_addr, count(*) AS n_tx, CAST(sum(suspected_drainer) AS BIGINT) AS n_flagged,
       CAST(sum(w1_burst) AS BIGINT) AS n_burst, CAST(sum(w4_zero_drain) AS BIGINT) AS n_zero_drain,
       CAST(sum(w5_nonce_jump) AS BIGINT) AS n_nonce_jump, round(sum(value_eth), 6) AS total_value
FROM flagged GROUP BY from_addr"""))
def q_drainer_by_sender(spark, sf):
    """Per-sender roll-up of the drainer flags (the flagship slice)."""
    f = R.detect_drainers(tx_view(spark, sf))
    return f.groupBy("from_addr").agg(
        F.count(F.lit(1)).alias("n_tx"),
        F.sum("suspected_drainer").cast("bigint").alias("n_flagged"),
        F.sum("w1_burst").cast("bigint").alias("n_burst"),
        F.sum("w4_zero_drain").cast("bigint").alias("n_zero_drain"),
        F.sum("w5_nonce_jump").cast("bigint").alias("n_nonce_jump"),
        F.sum("value_eth").alias("total_value"))


@register("drainer_flags_declared",
          with_tx(drainer_sql(R.RuleParams.declared()) + f"""
SELECT {FLAG_OUT},
       round(0.3 * w1_burst + 0.25 * w2_value_gas + 0.2 * w3_fanout + 0.15 * w4_zero_drain
             + 0.1 * w5_nonce_jump, 6) AS pattern_score
FROM flagged"""))
def q_drainer_flags_declared(spark, sf):
    """R1 + R2: the declared thresholds and the weighted pattern score."""
    f = R.pattern_score(R.detect_drainers(tx_view(spark, sf), R.RuleParams.declared()))
    return f.select("hash", "from_addr", "to_addr", *R.FLAG_COLS, "suspected_drainer", "pattern_score")


def _scored(spark, sf):
    tx = tx_view(spark, sf)
    st = R.global_stats(tx, anomaly=True)  # one quantile job for every threshold
    return R.threshold_labels(R.anomaly_score(R.detect_drainers(tx, stats=st), stats=st))


@register("anomaly_labels", with_tx(drainer_sql(R.RuleParams.coded()) + "," + ANOMALY_SQL + """
SELECT hash, w7_extreme_value, w8_gas_outlier, w9_busy_sender, w10_zero_value, anomaly_score,
       is_fraud_synthetic FROM labelled"""))
def q_anomaly_labels(spark, sf):
    """Anomaly points, score and threshold label."""
    d = _scored(spark, sf)
    return d.select("hash", "w7_extreme_value", "w8_gas_outlier", "w9_busy_sender",
                    "w10_zero_value", "anomaly_score", "is_fraud_synthetic")


@register("anomaly_label_counts", with_tx(drainer_sql(R.RuleParams.coded()) + "," + ANOMALY_SQL + """
SELECT anomaly_score, count(*) AS n, CAST(sum(is_fraud_synthetic) AS BIGINT) AS n_fraud
FROM labelled GROUP BY anomaly_score"""))
def q_anomaly_label_counts(spark, sf):
    """W11/W12 distribution: rows and labels per score."""
    d = _scored(spark, sf)
    return d.groupBy("anomaly_score").agg(F.count(F.lit(1)).alias("n"),
                                          F.sum("is_fraud_synthetic").cast("bigint").alias("n_fraud"))


def _labelled(spark, sf):
    tx = tx_view(spark, sf)
    return R.label_transactions(tx, scam_seed(tx))


@register("scam_labels", with_tx(drainer_sql(R.RuleParams.coded()) + "," + ANOMALY_SQL + ","
                                 + SCAM_SQL + """
SELECT hash, is_fraud_known, is_fraud_synthetic, is_fraud FROM policy"""))
def q_scam_labels(spark, sf):
    """W13 + W14: known-scam label and the label policy."""
    return _labelled(spark, sf).select("hash", "is_fraud_known", "is_fraud_synthetic", "is_fraud")


@register("top_risk", with_tx(drainer_sql(R.RuleParams.coded()) + "," + ANOMALY_SQL + ","
                              + SCAM_SQL + """
SELECT hash, from_addr, to_addr, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp,
       anomaly_score AS fraud_score, is_fraud_synthetic AS prediction, is_fraud AS actual
FROM policy ORDER BY anomaly_score DESC, hash LIMIT 15"""))
def q_top_risk(spark, sf):
    """The 15 highest-risk transactions."""
    return R.top_risk(_labelled(spark, sf))


@register("value_zscore", with_tx("""
z AS (SELECT hash, value_eth,
             count(value_eth) OVER w AS prior_n,
             CAST(sum(CAST(value_eth AS DECIMAL(20,6))) OVER w AS DOUBLE) / count(value_eth) OVER w AS prior_mean,
             stddev_samp(value_eth) OVER w AS prior_std
      FROM tx WHERE from_addr IS NOT NULL
      WINDOW w AS (PARTITION BY from_addr ORDER BY ts, block_number, tx_index, hash
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT hash, CAST(prior_n AS BIGINT) AS prior_n, round(prior_mean, 6) AS prior_mean,
       round(CASE WHEN prior_n >= 2 THEN prior_std END, 6) AS prior_std,
       round(CASE WHEN prior_n >= 2 AND prior_std > 0 THEN (value_eth - prior_mean) / prior_std END, 6) AS value_z,
       CASE WHEN prior_n >= 2 AND prior_std > 0 AND abs((value_eth - prior_mean) / prior_std) > 3
            THEN 1 ELSE 0 END AS r3_value_outlier
FROM z"""))
def q_value_zscore(spark, sf):
    """Value z-score against the sender's earlier transactions."""
    d = R.value_zscore_outliers(tx_view(spark, sf))
    return d.select("hash", "prior_n", "prior_mean", "prior_std", "value_z", "r3_value_outlier")


@register("gas_iqr_outliers", with_tx("""
g AS (SELECT quantile_cont(gas_price, 0.25) AS q1, quantile_cont(gas_price, 0.75) AS q3 FROM tx)
SELECT hash, CASE WHEN gas_price < q1 - 1.5 * (q3 - q1) OR gas_price > q3 + 1.5 * (q3 - q1)
                  THEN 1 ELSE 0 END AS r4_gas_iqr_outlier
FROM tx CROSS JOIN g"""))
def q_gas_iqr(spark, sf):
    """Gas-price IQR outliers."""
    return R.gas_iqr_outliers(tx_view(spark, sf)).select("hash", "r4_gas_iqr_outlier")


@register("entropy_shift", with_tx("""
b AS (SELECT from_addr, to_addr,
             (row_number() OVER (PARTITION BY from_addr ORDER BY ts, block_number, tx_index, hash) - 1) // 100 AS tx_block
      FROM tx WHERE from_addr IS NOT NULL),
p AS (SELECT from_addr, tx_block, to_addr, count(*) AS c FROM b GROUP BY ALL),
e AS (SELECT from_addr, tx_block, CAST(sum(c) AS BIGINT) AS n_tx,
             ln(sum(c)) - sum(c * ln(c)) / sum(c) AS entropy FROM p GROUP BY from_addr, tx_block),
e2 AS (SELECT e.*, entropy - lag(entropy) OVER (PARTITION BY from_addr ORDER BY tx_block) AS entropy_change FROM e)
SELECT from_addr, tx_block, n_tx, round(entropy, 6) AS entropy, round(entropy_change, 6) AS entropy_change,
       CASE WHEN abs(entropy_change) >= 0.5 THEN 1 ELSE 0 END AS r5_entropy_shift
FROM e2"""))
def q_entropy_shift(spark, sf):
    """Receiver entropy per block of 100 transactions and its change."""
    return R.counterparty_entropy_change(tx_view(spark, sf), window_size=100)


@register("risk_vote", with_tx(drainer_sql(R.RuleParams.coded()) + "," + ANOMALY_SQL + ","
                               + SCAM_SQL + """
SELECT hash, round(is_fraud_known * 1.0 + suspected_drainer * 0.6 + anomaly_score / 7.0 * 0.3, 6) AS risk_score,
       round(CAST(least(1.0, is_fraud_known * 1.0 + suspected_drainer * 0.6 + is_fraud_synthetic * 0.3) AS DOUBLE), 6)
         AS vote_confidence,
       CASE WHEN is_fraud_known * 1.0 + suspected_drainer * 0.6 + is_fraud_synthetic * 0.3 >= 0.7
            THEN 1 ELSE 0 END AS is_fraud_vote
FROM policy"""))
def q_risk_vote(spark, sf):
    """R6 (as its SQL, without the centrality weight) + R7: weighted risk score and
    weighted-vote label. ``risk_score_all`` has all four weights."""
    d = R.weighted_vote_labels(R.risk_score(_labelled(spark, sf)))
    return d.select("hash", "risk_score", "vote_confidence", "is_fraud_vote")


@register("risk_score_all")
def q_risk_score_all(spark, sf):
    """R6 with all four weights; centrality is the sender's degree centrality, at most 1."""
    d = _labelled(spark, sf)
    c = G.degree_centrality(G.build_edges(tx_view(spark, sf))).select(
        F.col("address").alias("from_addr"), F.least(F.lit(1.0), F.col("degree_centrality")).alias("centrality"))
    d = R.risk_score(d.join(c, "from_addr", "left"), centrality_col="centrality")
    return d.select("hash", "centrality", "risk_score")
