"""Wallet-drainer rules, anomaly score and labels.

Every operator takes a transaction DataFrame (see ``sources.tables``) and
returns it with extra columns. Global statistics (quantiles, mean, std) are
one-row DataFrames cross-joined by broadcast; sequence conditions and sender-level
aggregates of senders whose rows fit into one task are windows in one exchange by sender;
for busier senders the (sender, time bucket) windows of ``functions.windows`` and broadcast
aggregates hold, so no busy sender is ever held by one task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import flag
from ..functions.joins import BROADCAST_KEYS, land, lookup, window_totals
from ..functions.quantiles import quantile_values, small_domain_quantile
from ..functions.windows import WEEK_US, BucketedSequence, Cells, busy_keys, cell_bound, dealt, row_counts, within
from ..session import checkpoint_dir
from ..sources.tables import TX_ORDER, micros

US = 1_000_000
# Token amounts are summed exactly in decimal, then turned into doubles.
MONEY = "decimal(20,6)"


@dataclass(frozen=True)
class RuleParams:
    """Thresholds of W1-W5. ``coded()`` is the behaviour of the original
    detector, ``declared()`` the values of its rule configuration (R1)."""

    # W1 burst drain
    burst_min_tx: int = 5
    burst_gap_s: float = 60.0
    burst_min_rapid: int = 4
    # W2 high value, low gas: quantile form ...
    high_value_q: float | None = 0.95
    low_gas_q: float | None = 0.10
    # ... or absolute form (declared)
    min_value_eth: float | None = None
    max_gas_price_gwei: float | None = None
    min_value_to_gas: float | None = None
    # W3 fan-out
    fanout_min_tx: int = 3
    fanout_ratio: float = 0.8
    # W4 zero-value then drain
    zero_window_s: int = 600
    follower_q: float | None = 0.90
    follower_min_value: float | None = None
    # W5 nonce jump
    nonce_jump: int = 5
    nonce_window_s: int | None = None

    @staticmethod
    def coded() -> "RuleParams":
        return RuleParams()

    @staticmethod
    def declared() -> "RuleParams":
        # fixed values of the declared rule configuration
        return RuleParams(
            burst_min_tx=5, burst_gap_s=60.0, burst_min_rapid=4,
            high_value_q=None, low_gas_q=None,
            min_value_eth=0.1, max_gas_price_gwei=1.0, min_value_to_gas=1000.0,
            fanout_min_tx=10, fanout_ratio=0.8,
            zero_window_s=300, follower_q=None, follower_min_value=0.01,
            nonce_jump=5, nonce_window_s=600)


# Weights of the declared pattern score (R2) and risk score (R6); fixed values.
PATTERN_WEIGHTS = {"w1_burst": 0.30, "w2_value_gas": 0.25, "w3_fanout": 0.20,
                   "w4_zero_drain": 0.15, "w5_nonce_jump": 0.10}
RISK_WEIGHTS = {"known_scam": 1.0, "drainer": 0.6, "anomaly": 0.3, "centrality": 0.1}
VOTE_WEIGHTS = {"known": 1.0, "drainer": 0.6, "anomaly": 0.3}
VOTE_MIN_CONFIDENCE = 0.7

FLAG_COLS = ("w1_burst", "w2_value_gas", "w3_fanout", "w4_zero_drain", "w5_nonce_jump")


def global_stats(tx: DataFrame, p: RuleParams | None = None, anomaly: bool = False) -> dict:
    """Every global threshold the rules need, computed in one exact-quantile job
    plus one aggregate, returned as driver-side scalars (one row each)."""
    p = p or RuleParams.coded()
    specs = []
    if p.high_value_q is not None:
        specs.append(("v_hi", "value_eth", p.high_value_q))
    if p.low_gas_q is not None:
        specs.append(("g_lo", "gas_price", p.low_gas_q))
    if p.follower_q is not None:
        specs.append(("v_follow", "value_eth", p.follower_q))
    if anomaly:
        specs += [("v_q98", "value_eth", 0.98), ("v_q02", "value_eth", 0.02)]
    out = quantile_values(tx, specs) if specs else {}
    row = tx.agg(F.max("value_eth").alias("v_max"), F.avg("gas_price").alias("g_mean"),
                 F.stddev_samp("gas_price").alias("g_std")).collect()[0]
    out.update(row.asDict())
    return out


def _lit(v):
    return F.lit(v).cast("double") if v is not None else F.lit(None).cast("double")


def _with_w4(d: DataFrame, span, win: int, follower: Column) -> DataFrame:
    """A zero-value row with a ``follower`` row of its sender in ``(t, t + win]``, or any row in the window behind such
    a row; ``span(lo, hi)`` is the sender's window over a range of time."""
    e = d.withColumn("_led", F.max(flag(follower)).over(span(1, win)))
    e = e.withColumn("_hit", flag((F.col("value_eth") == 0) & (F.col("_led") == 1)))
    e = e.withColumn("w4_zero_drain", F.greatest(F.col("_hit"), F.coalesce(F.max("_hit").over(span(-win, -1)), F.lit(0))))
    return e.drop("_led", "_hit")


def light_sequence(d: DataFrame, win: int, follower: Column) -> DataFrame:
    """Senders whose rows fit into one task: windows over the sender alone (one exchange)."""
    w = Window.partitionBy("from_addr")
    rows = w.orderBy("_t", *TX_ORDER[1:])
    d = d.withColumns({"prev__t": F.lag("_t").over(rows), "prev_nonce": F.lag("nonce").over(rows)})
    return _with_w4(d, lambda lo, hi: w.orderBy("_t").rangeBetween(lo, hi), win, follower)


def busy_sequence(d: DataFrame, win: int, follower: Column, bucket_us: int, bound: int, most: int) -> DataFrame:
    """Busy senders: rows are spread over (sender, week) partitions with copies of neighbouring rows for the frames; those
    with more rows in a week than a task should hold go through split cells instead."""
    order = ("_t",) + TX_ORDER[1:]

    def framed(rows: DataFrame) -> DataFrame:
        seq = BucketedSequence.build(rows, "from_addr", "_t", order, bucket_us, back_us=win, fwd_us=win).lag_columns(["_t", "nonce"])
        return _with_w4(seq.df, seq.range, win, follower).where(F.col("_own")).drop("_own", "_pb", "_b")

    heavy = Cells(d, "from_addr", "_t", bound, bucket_us).keys()
    if heavy is None:
        return framed(d)
    zero = F.col("value_eth") == 0
    hot = d.join(F.broadcast(heavy), "from_addr", "left_semi")  # fewer than rows / bound senders
    seq = BucketedSequence.in_cells(hot, "from_addr", "_t", order, bound, most, bucket_us).lag_columns(["_t", "nonce"]).owned()
    near = within(hot, "from_addr", "_t", follower, win, zero, bound)
    e = seq.join(near, ["from_addr", "_t"])
    e = e.withColumn("w4_zero_drain", F.greatest(flag(zero & (F.col("_leads") == 1)), F.col("_follows")))
    light = framed(d.join(F.broadcast(heavy), "from_addr", "left_anti"))
    return light.unionByName(e.select(*light.columns))


def detect_drainers(tx: DataFrame, params: RuleParams | None = None,
                    bucket_us: int = WEEK_US, stats: dict | None = None) -> DataFrame:
    """Adds the five rule flags, ``suspected_drainer`` and ``sender_rows``.
    A row without a sender keeps W2 and has 0 in everything that looks at its sender. Without such rows and busy
    senders the result lies by sender, so that what follows needs no exchange by it."""
    p = params or RuleParams.coded()
    st = stats or global_stats(tx, p)
    consts = {"_" + k: _lit(st.get(k)) for k in ("v_hi", "g_lo", "v_follow", "v_max")}
    if p.follower_q is not None:
        follower = F.col("value_eth") > consts["_v_follow"]
    else:
        follower = F.col("value_eth") >= F.lit(p.follower_min_value)
    known = tx.where(F.col("from_addr").isNotNull()).withColumn("_t", micros("ts"))
    win = p.zero_window_s * US
    gap_s = (F.col("_t") - F.col("prev__t")) / F.lit(float(US))
    # Sender-level aggregates beside the rows they come from
    totals = {"sender_rows": F.count(F.lit(1)), "_rapid": F.count(F.when(F.col("_gap_s") < p.burst_gap_s, 1))}
    bound, most = cell_bound(known, "from_addr")
    n, none = row_counts(tx, "from_addr")
    if most > bound:
        checkpoint_dir(tx.sparkSession)
        busy = F.broadcast(busy_keys(known, "from_addr", bound).checkpoint())
        hot, known = known.join(busy, "from_addr", "left_semi"), known.join(busy, "from_addr", "left_anti")
    d = window_totals(light_sequence(dealt(known, n, "from_addr"), win, follower).withColumn("_gap_s", gap_s), ["from_addr"], totals, {"_n_to": "to_addr"})
    if most > bound:
        seq = land(busy_sequence(hot, win, follower, bucket_us, bound, most).withColumn("_gap_s", gap_s))
        per_sender = seq.groupBy("from_addr").agg(*[a.alias(c) for c, a in totals.items()], F.count_distinct("to_addr").alias("_n_to"))
        d = d.unionByName(seq.join(F.broadcast(per_sender), "from_addr"))  # fewer than rows / bound senders
    d = d.withColumns(consts)
    # W5 nonce jump against the previous transaction of the sender
    jump = (F.col("nonce") - F.col("prev_nonce")) > p.nonce_jump
    if p.nonce_window_s is not None:
        jump = jump & (F.col("_gap_s") <= p.nonce_window_s)
    d = d.withColumn("w5_nonce_jump", flag(jump))
    nobody = tx.where(F.col("from_addr").isNull()).withColumns(
        {**consts, "w4_zero_drain": F.lit(0), "w5_nonce_jump": F.lit(0), "w1_burst": F.lit(0), "w3_fanout": F.lit(0),
         "sender_rows": F.lit(0).cast("bigint")})
    # W2 high value with low gas (global thresholds)
    if p.high_value_q is not None:
        w2 = ((F.col("_v_max") > 0) & (F.col("value_eth") > F.col("_v_hi"))
              & (F.col("gas_price") < F.col("_g_lo")))
    else:
        gas_cost = F.col("gas") * F.col("gas_price") / F.lit(1e18)
        w2 = ((F.col("value_eth") >= p.min_value_eth)
              & (F.col("gas_price") / F.lit(1e9) <= p.max_gas_price_gwei)
              & (F.try_divide(F.col("value_eth"), gas_cost) >= p.min_value_to_gas))
    d, nobody = d.withColumn("w2_value_gas", flag(w2)), nobody.withColumn("w2_value_gas", flag(w2))

    d = d.withColumn("w1_burst", flag((F.col("sender_rows") >= p.burst_min_tx)
                                      & (F.col("_rapid") >= p.burst_min_rapid)))
    d = d.withColumn("w3_fanout", flag((F.col("sender_rows") >= p.fanout_min_tx)
                                       & (F.col("_n_to") >= F.col("sender_rows") * p.fanout_ratio)))
    drop = [c for c in d.columns if c.startswith("_") or c.startswith("prev_")]
    d = d.drop(*drop)
    if none:  # else the rows go on lying by sender
        d = d.unionByName(nobody.select(*d.columns))
    return d.withColumn(
        "suspected_drainer", F.greatest(*[F.col(c) for c in FLAG_COLS]))


def drainer_summary(flagged: DataFrame) -> DataFrame:
    """W6 count and rate as one row."""
    return flagged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.sum(c).cast("bigint").alias(f"n_{c}") for c in FLAG_COLS],
        F.sum("suspected_drainer").cast("bigint").alias("n_drainer"),
        (F.avg("suspected_drainer")).alias("drainer_rate"))


def anomaly_score(flagged: DataFrame, include_drainer: bool = True,
                  busy_min: int = 10, stats: dict | None = None) -> DataFrame:
    """W7-W11 on the output of ``detect_drainers``. Pass the ``stats`` of the
    transaction table (``global_stats(tx, anomaly=True)``) to avoid computing
    them over the flagged plan."""
    st = stats or global_stats(flagged, anomaly=True)
    d = flagged
    d = d.withColumn("w7_extreme_value", flag((F.col("value_eth") > _lit(st["v_q98"]))
                                              | (F.col("value_eth") < _lit(st["v_q02"]))))
    g_std = st.get("g_std")
    if g_std is not None and g_std > 0:
        z = F.abs((F.col("gas_price") - _lit(st["g_mean"])) / _lit(g_std))
        d = d.withColumn("w8_gas_outlier", flag(z > 3))
    else:
        d = d.withColumn("w8_gas_outlier", F.lit(0))
    d = d.withColumn("w9_busy_sender", flag(F.col("sender_rows") > busy_min))
    d = d.withColumn("w10_zero_value", flag(F.col("value_eth") == 0))
    score = (F.col("w7_extreme_value") + F.col("w8_gas_outlier") + F.col("w9_busy_sender")
             + F.col("w10_zero_value"))
    if include_drainer:
        score = score + 3 * F.col("suspected_drainer")
    return d.withColumn("anomaly_score", score.cast("int"))


def threshold_labels(scored: DataFrame, contamination: float = 0.05,
                     out: str = "is_fraud_synthetic") -> DataFrame:
    """label = score >= linear percentile of the score at 1 - contamination.
    Ties at the threshold all get the label (so the rate can exceed the budget).
    The score has at most eight values, so its exact quantile comes from the
    score histogram. The scored table is read twice, so it is landed."""
    scored = land(scored)
    thr = small_domain_quantile(scored, "anomaly_score", 1.0 - contamination)
    return scored.withColumn(out, flag(F.col("anomaly_score") >= _lit(thr)))


def known_scam_labels(tx: DataFrame, scam: DataFrame, out: str = "is_fraud_known") -> DataFrame:
    """1 if sender or receiver is in the scam set. The set is distinct-ed and
    joined twice (left), by broadcast up to ``BROADCAST_KEYS`` addresses; else rows
    without a sender or receiver are dealt evenly."""
    checkpoint_dir(tx.sparkSession)
    s = scam.select(F.col("address")).where("address is not null").distinct().checkpoint()
    f = s.select(F.col("address").alias("from_addr"), F.lit(1).alias("_sf"))
    t = s.select(F.col("address").alias("to_addr"), F.lit(1).alias("_st"))
    if s.count() <= BROADCAST_KEYS:
        d = tx.join(F.broadcast(f), "from_addr", "left").join(F.broadcast(t), "to_addr", "left").select(*tx.columns, "_sf", "_st")
    else:
        d = lookup(lookup(tx, f, "from_addr", ["hash"]), t, "to_addr", ["hash"])
    return d.withColumn(out, flag((F.col("_sf") == 1) | (F.col("_st") == 1))).drop("_sf", "_st")


def label_transactions(tx: DataFrame, scam: DataFrame, use_synthetic: bool = True,
                       contamination: float = 0.05, params: RuleParams | None = None,
                       include_drainer: bool = True) -> DataFrame:
    """Known-scam labels; if they find nothing and ``use_synthetic``, the
    threshold labels replace them for the whole table (a global switch, decided
    by a one-row aggregate)."""
    p = params or RuleParams.coded()
    st = global_stats(tx, p, anomaly=True)
    known = known_scam_labels(tx, scam)
    flagged = detect_drainers(known, p, stats=st)
    scored = threshold_labels(anomaly_score(flagged, include_drainer, stats=st), contamination)
    n_known = scored.agg(F.sum("is_fraud_known").alias("_n_known"))
    d = scored.crossJoin(F.broadcast(n_known))
    use_syn = (F.coalesce(F.col("_n_known"), F.lit(0)) == 0) & F.lit(use_synthetic)
    return (d.withColumn("is_fraud", F.when(use_syn, F.col("is_fraud_synthetic"))
                         .otherwise(F.col("is_fraud_known")).cast("int"))
            .drop("_n_known"))


def top_risk(scored: DataFrame, score_col: str = "anomaly_score", n: int = 15,
             pred_col: str = "is_fraud_synthetic", actual_col: str = "is_fraud") -> DataFrame:
    """The n highest scores (ties broken by hash) with formatted time."""
    return (scored.orderBy(F.col(score_col).desc(), F.col("hash").asc()).limit(n)
            .select("hash", "from_addr", "to_addr",
                    F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                    F.col(score_col).alias("fraud_score"),
                    F.col(pred_col).cast("int").alias("prediction"),
                    F.col(actual_col).cast("int").alias("actual")))


# ---------------------------------------------------------------- R2-R7


def pattern_score(flagged: DataFrame) -> DataFrame:
    """R2: weighted sum of the five pattern flags."""
    s = sum(F.col(c) * F.lit(w) for c, w in PATTERN_WEIGHTS.items())
    return flagged.withColumn("pattern_score", s)


def value_zscore_outliers(tx: DataFrame, threshold: float = 3.0,
                          bucket_us: int = WEEK_US) -> DataFrame:
    """Z-score of the value against the sender's own *earlier* transactions
    (mean and sample std of all preceding rows); flag when |z| > threshold.
    A row without a sender has no earlier ones.
    The running totals are a distributed prefix sum (see ``BucketedSequence``)."""
    d = tx.where(F.col("from_addr").isNotNull()).withColumn("_t", micros("ts"))
    order = ("_t",) + TX_ORDER[1:]
    x = F.col("value_eth")
    # exact sums in integer micro-units: u = value * 1e6 as decimal(38,0)
    u = F.round(x.cast(MONEY) * F.lit(1000000)).cast("decimal(38,0)")
    seq = BucketedSequence.in_cells(d, "from_addr", "_t", order, *cell_bound(d, "from_addr"), bucket_us).prefix_sums(
        {"_n": F.when(x.isNotNull(), F.lit(1)).otherwise(F.lit(0)),
         "_s": F.coalesce(u, F.lit(0).cast("decimal(38,0)")),
         "_q": F.coalesce(F.try_multiply(u, u), F.lit(0).cast("decimal(38,0)")),
         "_qd": F.coalesce(x * x, F.lit(0.0))})
    n, su, qu = F.col("_n"), F.col("_s"), F.col("_q")
    s = su.cast("double") / F.lit(1e6)
    mean = F.try_divide(s, n.cast("double"))
    # n * sum(u^2) - sum(u)^2 is exact in decimal; doubles only if it overflows
    num = F.try_subtract(F.try_multiply(n.cast("decimal(38,0)"), qu), F.try_multiply(su, su))
    var_exact = F.try_divide(num.cast("double"), (n * (n - 1)).cast("double")) / F.lit(1e12)
    var_dbl = F.try_divide(F.col("_qd") - s * s / n, (n - 1).cast("double"))
    var = F.coalesce(var_exact, var_dbl)
    std = F.sqrt(F.greatest(var, F.lit(0.0)))
    e = (seq.owned()
         .withColumn("prior_n", n.cast("bigint"))
         .withColumn("prior_mean", mean)
         .withColumn("prior_std", F.when(n >= 2, std))
         .withColumn("value_z", F.when((n >= 2) & (std > 0), F.try_divide(x - mean, std)))
         .withColumn("r3_value_outlier", flag(F.abs(F.col("value_z")) > threshold)))
    e = e.drop("_t", "_n", "_s", "_q", "_qd")
    nobody = tx.where(F.col("from_addr").isNull()).withColumns(
        {"prior_n": F.lit(0).cast("bigint"), "prior_mean": F.lit(None).cast("double"), "prior_std": F.lit(None).cast("double"),
         "value_z": F.lit(None).cast("double"), "r3_value_outlier": F.lit(0)})
    return e.unionByName(nobody.select(*e.columns))


def gas_iqr_outliers(tx: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Gas price outside [q1 - m IQR, q3 + m IQR] (linear quartiles)."""
    q = quantile_values(tx, [("q1", "gas_price", 0.25), ("q3", "gas_price", 0.75)])
    if q["q1"] is None:
        return tx.withColumn("r4_gas_iqr_outlier", F.lit(0))
    iqr = q["q3"] - q["q1"]
    lo, hi = q["q1"] - multiplier * iqr, q["q3"] + multiplier * iqr
    return tx.withColumn("r4_gas_iqr_outlier",
                         flag((F.col("gas_price") < _lit(lo)) | (F.col("gas_price") > _lit(hi))))


def counterparty_entropy_change(tx: DataFrame, window_size: int = 100,
                                threshold: float = 0.5, bucket_us: int = WEEK_US) -> DataFrame:
    """Shannon entropy (nats) of a sender's receivers over consecutive blocks
    of ``window_size`` transactions, and its change against the previous block;
    flagged when |change| >= threshold. One row per (sender, block). The row
    index inside a sender is a distributed prefix count, not a sender-wide
    ``row_number`` (which would put a busy sender in one task)."""
    d = tx.where(F.col("from_addr").isNotNull()).withColumn("_t", micros("ts"))
    order = ("_t",) + TX_ORDER[1:]
    seq = BucketedSequence.in_cells(d, "from_addr", "_t", order, *cell_bound(d, "from_addr"), bucket_us).prefix_sums(
        {"_idx": F.lit(1)})
    d = seq.owned().withColumn("_blk", F.floor(F.col("_idx") / window_size).cast("bigint"))
    pair = d.groupBy("from_addr", "_blk", "to_addr").agg(F.count(F.lit(1)).alias("_c"))
    tot = pair.groupBy("from_addr", "_blk").agg(
        F.sum("_c").alias("n_tx"),
        F.sum(F.col("_c") * F.log(F.col("_c"))).alias("_clogc"))
    ent = tot.select("from_addr", F.col("_blk").alias("tx_block"), F.col("n_tx").cast("bigint"),
                     (F.log(F.col("n_tx")) - F.col("_clogc") / F.col("n_tx")).alias("entropy"))
    # previous block by equi-join on (sender, block - 1): a busy sender's blocks
    # are hashed over many partitions instead of one window partition
    prev = ent.select("from_addr", (F.col("tx_block") + 1).alias("tx_block"),
                      F.col("entropy").alias("_prev_entropy"))
    ent = (ent.join(prev, ["from_addr", "tx_block"], "left")
           .withColumn("entropy_change", F.col("entropy") - F.col("_prev_entropy")).drop("_prev_entropy"))
    return ent.withColumn("r5_entropy_shift",
                          flag(F.abs(F.col("entropy_change")) >= threshold))


def risk_score(df: DataFrame, known_col: str = "is_fraud_known",
               drainer_col: str = "suspected_drainer", anomaly_col: str = "anomaly_score",
               anomaly_max: float = 7.0, centrality_col: str | None = None) -> DataFrame:
    """Weighted risk score from known-scam, drainer, anomaly (scaled to 0-1)
    and optional centrality (0-1) components."""
    s = (F.col(known_col) * RISK_WEIGHTS["known_scam"]
         + F.col(drainer_col) * RISK_WEIGHTS["drainer"]
         + F.col(anomaly_col) / F.lit(anomaly_max) * RISK_WEIGHTS["anomaly"])
    if centrality_col:
        s = s + F.coalesce(F.col(centrality_col), F.lit(0.0)) * RISK_WEIGHTS["centrality"]
    return df.withColumn("risk_score", s)


def weighted_vote_labels(df: DataFrame, known_col: str = "is_fraud_known",
                         drainer_col: str = "suspected_drainer",
                         anomaly_col: str = "is_fraud_synthetic",
                         min_confidence: float = VOTE_MIN_CONFIDENCE) -> DataFrame:
    """confidence = sum of the weights of the sources that fire, at most 1;
    label only when confidence >= min_confidence."""
    conf = F.least(F.lit(1.0), F.round(F.col(known_col) * VOTE_WEIGHTS["known"]
                                       + F.col(drainer_col) * VOTE_WEIGHTS["drainer"]
                                       + F.col(anomaly_col) * VOTE_WEIGHTS["anomaly"], 6))
    return (df.withColumn("vote_confidence", conf.cast("double"))
            .withColumn("is_fraud_vote", flag(F.col("vote_confidence") >= min_confidence)))


