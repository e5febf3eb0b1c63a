"""Registered queries for metrics (E1-E11) and profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators import profile as P
from ..operators import rules as R
from ..sources.tables import read_table, scam_seed, tx_view
from .registry import register, with_tx
from .rule_queries import drainer_sql

# Score table on the transaction view: label = failed transaction, score = a
# bounded rescaling of the value (ties at 0 for the zero-value rows).
SCORES_SQL = """s AS (SELECT hash, is_error AS y, value_eth / 110.0 AS score FROM tx)"""


def scores(spark, sf):
    return tx_view(spark, sf).select("hash", F.col("is_error").alias("y"),
                                     (F.col("value_eth") / F.lit(110.0)).alias("score"))


def scored(spark, sf):
    return M.with_predictions(scores(spark, sf))


CONF_SQL = """c AS (SELECT count(CASE WHEN y = 0 AND score <= 0.5 THEN 1 END) AS tn,
              count(CASE WHEN y = 0 AND score > 0.5 THEN 1 END) AS fp,
              count(CASE WHEN y = 1 AND score <= 0.5 THEN 1 END) AS fn,
              count(CASE WHEN y = 1 AND score > 0.5 THEN 1 END) AS tp FROM s)"""


def _z(a, b):
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), 0.0)"


@register("confusion_metrics", with_tx(SCORES_SQL + ",\n" + CONF_SQL + f""",
m AS (SELECT c.*, {_z('tp', 'tp + fp')} AS p, {_z('tp', 'tp + fn')} AS r FROM c)
SELECT tn, fp, fn, tp, round(p, 6) AS precision, round(r, 6) AS recall,
       round({_z('2 * p * r', 'p + r')}, 6) AS f1, round({_z('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy,
       round({_z('fp', 'fp + tn')}, 6) AS false_positive_rate,
       round({_z('fn', 'fn + tp')}, 6) AS false_negative_rate FROM m"""))
def q_confusion(spark, sf):
    """E1-E3 at threshold 0.5."""
    return M.classification_scores(scored(spark, sf))


@register("classification_report", with_tx(SCORES_SQL + ",\n" + CONF_SQL + f""",
per AS (SELECT '0' AS label, {_z('tn', 'tn + fn')} AS precision, {_z('tn', 'tn + fp')} AS recall,
               CAST(tn + fp AS BIGINT) AS support FROM c
        UNION ALL
        SELECT '1', {_z('tp', 'tp + fp')}, {_z('tp', 'tp + fn')}, CAST(tp + fn AS BIGINT) FROM c),
per2 AS (SELECT per.*, {_z('2 * precision * recall', 'precision + recall')} AS f1_score FROM per),
tot AS (SELECT sum(support) AS n FROM per2)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
       support FROM per2
UNION ALL SELECT 'accuracy', NULL, NULL, round({_z('tp + tn', 'tp + tn + fp + fn')}, 6),
       CAST(tp + tn + fp + fn AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       CAST(sum(support) AS BIGINT) FROM per2
UNION ALL SELECT 'weighted avg', round({_z('sum(precision * support)', 'max(n)')}, 6),
       round({_z('sum(recall * support)', 'max(n)')}, 6), round({_z('sum(f1_score * support)', 'max(n)')}, 6),
       CAST(sum(support) AS BIGINT) FROM per2, tot"""))
def q_report(spark, sf):
    """Per-class report with accuracy and averages."""
    return M.classification_report(scored(spark, sf))


CURVE_SQL = SCORES_SQL + """,
g AS (SELECT score AS threshold, sum(y) AS pos, count(*) - sum(y) AS neg FROM s GROUP BY score),
c AS (SELECT threshold, pos, neg,
             sum(pos) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
             sum(neg) OVER (ORDER BY threshold DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp
      FROM g),
t AS (SELECT sum(y) AS P, count(*) - sum(y) AS N FROM s),
cp AS (SELECT threshold, CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(tp - pos AS DOUBLE) AS tpp,
              CAST(fp - neg AS DOUBLE) AS fpp, CAST(P AS DOUBLE) AS P, CAST(N AS DOUBLE) AS N FROM c, t),
pts AS (SELECT threshold,
               CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS p,
               CASE WHEN tpp + fpp = 0 THEN 1.0 ELSE tpp / (tpp + fpp) END AS pp,
               coalesce(tp / nullif(P, 0), 0.0) AS r, coalesce(tpp / nullif(P, 0), 0.0) AS rp,
               coalesce(fp / nullif(N, 0), 0.0) AS fpr, coalesce(fpp / nullif(N, 0), 0.0) AS fprp
        FROM cp)"""


@register("pr_curve", with_tx(CURVE_SQL + """
SELECT round(threshold, 6) AS threshold, round(p, 6) AS precision, round(r, 6) AS recall FROM pts
UNION ALL SELECT NULL, 1.0, 0.0"""))
def q_pr_curve(spark, sf):
    """E5: precision-recall points at every distinct score, plus the end point."""
    return M.pr_curve(scores(spark, sf))


@register("pr_auc", with_tx(CURVE_SQL + """
SELECT round(sum((r - rp) * (p + pp) / 2), 6) AS pr_auc, round(sum((r - rp) * p), 6) AS average_precision
FROM pts"""))
def q_pr_auc(spark, sf):
    """E6 + E7: trapezoidal PR-AUC from (0, 1) and average precision."""
    return M.pr_auc(scores(spark, sf))


@register("roc_curve", with_tx(CURVE_SQL + """
SELECT round(threshold, 6) AS threshold, round(fpr, 6) AS fpr, round(r, 6) AS tpr
FROM pts
UNION ALL SELECT NULL, 0.0, 0.0"""))
def q_roc_curve(spark, sf):
    """ROC points with the (0, 0) start."""
    return M.roc(scores(spark, sf))[0]


@register("roc_auc", with_tx(CURVE_SQL + """
SELECT round(sum((fpr - fprp) * (r + rp) / 2), 6) AS roc_auc FROM pts"""))
def q_roc_auc(spark, sf):
    """Trapezoidal ROC-AUC."""
    return M.roc(scores(spark, sf))[1]


LABEL_SCORES = """tx AS (SELECT CAST(l.doc_id AS VARCHAR) AS hash, l.quality AS is_error,
                                 d.n_chars / (d.n_chars + 1000.0) * 110.0 AS value_eth
                          FROM labels l JOIN documents d USING (doc_id))"""


@register("pr_auc_labels", with_tx(CURVE_SQL + """
SELECT round(sum((r - rp) * (p + pp) / 2), 6) AS pr_auc, round(sum((r - rp) * p), 6) AS average_precision
FROM pts""", LABEL_SCORES))
def q_pr_auc_labels(spark, sf):
    """E6 + E7 on document quality labels scored by a bounded function of length."""
    lab = read_table(spark, sf, "labels").join(read_table(spark, sf, "documents"), "doc_id")
    sc = lab.select(F.col("quality").alias("y"),
                    (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0)) * F.lit(110.0) / F.lit(110.0))
                    .alias("score"))
    return M.pr_auc(sc)


@register("detection_summary", with_tx(SCORES_SQL + f"""
SELECT count(*) AS n, count(CASE WHEN y = 1 THEN 1 END) AS n_fraud,
       round({_z('count(CASE WHEN y = 1 AND score > 0.5 THEN 1 END)', 'count(CASE WHEN y = 1 THEN 1 END)')}, 6)
         AS detection_rate,
       round({_z('count(CASE WHEN y = CASE WHEN score > 0.5 THEN 1 ELSE 0 END THEN 1 END)', 'count(*)')}, 6)
         AS accuracy
FROM s"""))
def q_detection(spark, sf):
    """Detection rate and accuracy."""
    return M.detection_summary(scored(spark, sf))


@register("hardest_cases", with_tx(SCORES_SQL + """
SELECT * FROM (SELECT 'true_positive' AS "case", hash, round(score, 6) AS score FROM s
               WHERE y = 1 AND score > 0.5 ORDER BY score DESC, hash DESC LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'false_positive', hash, round(score, 6) FROM s
               WHERE y = 0 AND score > 0.5 ORDER BY score DESC, hash DESC LIMIT 1)
UNION ALL
SELECT * FROM (SELECT 'false_negative', hash, round(score, 6) FROM s
               WHERE y = 1 AND score <= 0.5 ORDER BY score, hash LIMIT 1)"""))
def q_hardest(spark, sf):
    """Hardest true positive, false positive and false negative."""
    return M.hardest_cases(scored(spark, sf))


# ------------------------------------------------------------------ profile

LABELLED_SQL = """
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
lt AS (SELECT tx.*, CASE WHEN from_addr IN (SELECT address FROM scam)
                          OR to_addr IN (SELECT address FROM scam) THEN 1 ELSE 0 END AS is_fraud FROM tx)"""


def labelled(spark, sf):
    tx = tx_view(spark, sf)
    return R.known_scam_labels(tx, scam_seed(tx), out="is_fraud")


@register("class_distribution", with_tx(LABELLED_SQL + """
SELECT is_fraud, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM lt), 6) AS percent
FROM lt GROUP BY is_fraud"""))
def q_class_dist(spark, sf):
    """D2."""
    return P.class_distribution(labelled(spark, sf))


@register("label_drainer_crosstab", with_tx(drainer_sql(R.RuleParams.coded()) + "," + LABELLED_SQL + """,
j AS (SELECT lt.is_fraud, f.suspected_drainer FROM lt JOIN flagged f USING (hash)),
c AS (SELECT is_fraud, suspected_drainer, count(*) AS count FROM j GROUP BY ALL)
SELECT is_fraud, suspected_drainer, count,
       round(count / sum(count) OVER (PARTITION BY is_fraud), 6) AS share FROM c"""))
def q_crosstab(spark, sf):
    """D3: label x drainer, row-normalised."""
    tx = tx_view(spark, sf)
    d = R.known_scam_labels(R.detect_drainers(tx), scam_seed(tx), out="is_fraud")
    return P.crosstab_normalized(d, "is_fraud", "suspected_drainer")


@register("duplicate_hashes", with_tx("""
SELECT count(*) - count(DISTINCT hash) - max(CASE WHEN hash IS NULL THEN 1 ELSE 0 END) AS duplicates FROM tx"""))
def q_dups(spark, sf):
    """D5."""
    return P.duplicate_count(tx_view(spark, sf))


@register("time_range", with_tx("""
SELECT CAST(min(ts) AS VARCHAR) AS ts_min, CAST(max(ts) AS VARCHAR) AS ts_max FROM tx"""))
def q_time_range(spark, sf):
    """D6."""
    return P.time_range(tx_view(spark, sf)).select(*[F.col(c).cast("string").alias(c)
                                                       for c in ("ts_min", "ts_max")])


@register("daily_counts", with_tx("""
d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n_tx FROM tx GROUP BY ALL)
SELECT CAST(day AS VARCHAR) AS day, n_tx,
       CAST(sum(n_tx) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_tx
FROM d"""))
def q_daily(spark, sf):
    """Per day with running total."""
    d = P.daily_counts(tx_view(spark, sf))
    return d.select(F.col("day").cast("string").alias("day"), "n_tx", "cumulative_tx")


@register("hourly_histogram", with_tx("""
SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n_tx FROM tx GROUP BY ALL"""))
def q_hourly(spark, sf):
    """D8."""
    return P.hourly_histogram(tx_view(spark, sf))


@register("day_hour_matrix", with_tx("""
SELECT CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, """ + ",\n".join(
    f"count(CASE WHEN hour(ts) = {h} THEN 1 END) AS h{h}" for h in range(24)) + """
FROM tx GROUP BY ALL"""))
def q_day_hour(spark, sf):
    """D9."""
    return P.day_hour_matrix(tx_view(spark, sf))


def _hist_sql(name, expr, where, bins):
    return f"""SELECT '{name}' AS histogram, bin, round(lo + bin * (hi - lo) / {bins}, 6) AS lower,
       round(lo + (bin + 1) * (hi - lo) / {bins}, 6) AS upper, count(*) AS count
FROM (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) / ((hi - lo) / {bins})), {bins - 1}) END
                 AS INTEGER) AS bin, lo, hi
      FROM (SELECT {expr} AS x FROM tx WHERE {where}) v,
           (SELECT min({expr}) AS lo, max({expr}) AS hi FROM tx WHERE {where}) m)
GROUP BY bin, lo, hi"""


@register("value_histograms", with_tx("\n UNION ALL \n".join([
    _hist_sql("value", "value_eth", "value_eth > 0", 50),
    _hist_sql("log10_value", "log10(value_eth)", "value_eth > 0", 50),
    _hist_sql("gas_price", "CAST(gas_price AS DOUBLE)", "gas_price IS NOT NULL", 50),
    _hist_sql("probability", "value_eth / 110.0", "value_eth IS NOT NULL", 20)])))
def q_histograms(spark, sf):
    """Equal-width histograms (value, log10 value, gas price, probability)."""
    tx = tx_view(spark, sf)
    parts = [
        P.equal_width_histogram(tx, "value_eth", 50, where=lambda x: x > 0).withColumn("histogram", F.lit("value")),
        P.equal_width_histogram(tx.where(F.col("value_eth") > 0), "value_eth", 50, transform=F.log10)
        .withColumn("histogram", F.lit("log10_value")),
        P.equal_width_histogram(tx, "gas_price", 50).withColumn("histogram", F.lit("gas_price")),
        P.equal_width_histogram(tx.withColumn("p", F.col("value_eth") / F.lit(110.0)), "p", 20)
        .withColumn("histogram", F.lit("probability"))]
    out = parts[0]
    for p_ in parts[1:]:
        out = out.unionByName(p_)
    return out.select("histogram", "bin", "lower", "upper", "count")


@register("describe_by_class", with_tx("""
SELECT is_error, count(value_eth) AS count, round(avg(value_eth), 6) AS mean, round(stddev_samp(value_eth), 6) AS std,
       round(min(value_eth), 6) AS min, round(max(value_eth), 6) AS max,
       round(quantile_cont(value_eth, 0.25), 6) AS p25, round(quantile_cont(value_eth, 0.5), 6) AS p50,
       round(quantile_cont(value_eth, 0.75), 6) AS p75
FROM tx GROUP BY is_error"""))
def q_describe(spark, sf):
    """Value described per class (exact quartiles)."""
    return P.describe_by_class(tx_view(spark, sf), "value_eth", "is_error")


@register("box_stats", with_tx("""
q AS (SELECT is_error, quantile_cont(gas_price, 0.25) AS q1, quantile_cont(gas_price, 0.5) AS median,
             quantile_cont(gas_price, 0.75) AS q3 FROM tx GROUP BY is_error)
SELECT is_error, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
       round(min(CASE WHEN gas_price >= q1 - 1.5 * (q3 - q1) THEN gas_price END), 6) AS whisker_low,
       round(max(CASE WHEN gas_price <= q3 + 1.5 * (q3 - q1) THEN gas_price END), 6) AS whisker_high,
       count(CASE WHEN gas_price < q1 - 1.5 * (q3 - q1) OR gas_price > q3 + 1.5 * (q3 - q1) THEN 1 END) AS n_outliers,
       round(q3 - q1, 6) AS iqr
FROM tx JOIN q USING (is_error) GROUP BY is_error, q1, median, q3"""))
def q_box(spark, sf):
    """Gas-price box statistics per class."""
    d = P.box_stats(tx_view(spark, sf), "gas_price", "is_error")
    return d.select("is_error", "q1", "median", "q3", F.col("whisker_low").cast("double"),
                    F.col("whisker_high").cast("double"), "n_outliers", "iqr")


@register("top_counterparties", with_tx("""
SELECT * FROM (SELECT from_addr AS address, count(*) AS n_tx, 'sender' AS role FROM tx GROUP BY from_addr
               ORDER BY n_tx DESC, address LIMIT 10)
UNION ALL
SELECT * FROM (SELECT to_addr, count(*) AS n_tx, 'receiver' FROM tx GROUP BY to_addr
               ORDER BY n_tx DESC, to_addr LIMIT 10)"""))
def q_top_counterparties(spark, sf):
    """D13."""
    return P.top_counterparties(tx_view(spark, sf))


CORR_COLS = ["value_eth", "gas", "gas_price", "nonce", "is_error"]


def _corr_sql():
    rows = []
    for i, a in enumerate(CORR_COLS):
        for b in CORR_COLS[i + 1:]:
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, corr({a}, {b}) AS corr FROM tx")
            rows.append(f"SELECT '{b}' AS col_a, '{a}' AS col_b, corr({a}, {b}) AS corr FROM tx")
    return "\nUNION ALL\n".join(rows)


@register("correlation_matrix", with_tx(f"""
cm AS ({_corr_sql()})
SELECT col_a, col_b, round(corr, 6) AS corr FROM cm"""))
def q_corr(spark, sf):
    """Pairwise Pearson correlations."""
    return P.correlation_matrix(tx_view(spark, sf), CORR_COLS)


@register("label_correlation", with_tx(LABELLED_SQL + """,
lc AS (""" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, corr({c}, is_fraud) AS corr FROM lt" for c in CORR_COLS) + """)
SELECT feature, round(corr, 6) AS corr,
       CAST(row_number() OVER (ORDER BY abs(corr) DESC NULLS LAST, feature) AS INTEGER) AS rank FROM lc"""))
def q_label_corr(spark, sf):
    """Feature correlation with the label, ranked."""
    return P.label_correlation(labelled(spark, sf), "is_fraud", CORR_COLS)


@register("summary_line", with_tx(LABELLED_SQL + """
SELECT count(*) AS n_tx, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(avg(is_fraud), 6) AS fraud_rate,
       count(DISTINCT from_addr) AS unique_senders, count(DISTINCT to_addr) AS unique_receivers,
       round(CAST(sum(CAST(value_eth AS DECIMAL(20,6))) AS DOUBLE) / count(value_eth), 6) AS mean_value,
       round(quantile_cont(gas_price, 0.5), 6) AS median_gas_price
FROM lt"""))
def q_summary(spark, sf):
    """D16."""
    return P.summary_line(labelled(spark, sf))


@register("null_profile", with_tx("""
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
snd AS (SELECT from_addr AS Address, count(*) AS st FROM tx GROUP BY from_addr),
rcv AS (SELECT to_addr AS Address, count(*) AS rt FROM tx GROUP BY to_addr),
acc AS (SELECT coalesce(snd.Address, rcv.Address) AS Address, st, rt FROM snd FULL JOIN rcv ON snd.Address = rcv.Address),
a2 AS (SELECT acc.*, c.c_mktsegment AS segment FROM acc LEFT JOIN customer c ON c.c_custkey = acc.Address),
n AS (SELECT count(*) AS n, count(*) - count(Address) AS c0, count(*) - count(st) AS c1,
             count(*) - count(rt) AS c2, count(*) - count(segment) AS c3 FROM a2)
SELECT 'Address' AS column_name, c0 AS null_count, round(c0 * 100.0 / n, 6) AS null_pct FROM n
UNION ALL SELECT 'Sent tnx', c1, round(c1 * 100.0 / n, 6) FROM n
UNION ALL SELECT 'Received Tnx', c2, round(c2 * 100.0 / n, 6) FROM n
UNION ALL SELECT 'segment', c3, round(c3 * 100.0 / n, 6) FROM n"""))
def q_null_profile(spark, sf):
    """Null counts and percentages of the account table."""
    from ..sources.ingest import account_table
    tx = tx_view(spark, sf)
    acc = account_table(tx, spark, sf, scam_seed(tx)).select("Address", "Sent tnx", "Received Tnx", "segment")
    return P.null_profile(acc)


@register("pca_projection")
def q_pca(spark, sf):
    """First two principal components of the numeric transaction columns."""
    tx = tx_view(spark, sf)
    return P.pca_projection(tx, ["value_eth", "gas", "gas_price", "nonce"]).select("hash", "pc1", "pc2")
