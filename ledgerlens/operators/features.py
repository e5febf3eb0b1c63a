"""Per-transaction and per-account features.

Each function is ``DataFrame -> DataFrame`` over the transaction table. Sender
sequence features (gaps, trailing 24 h / 1 h counts) share one exchange on
(sender, week) with context copies; sender and receiver aggregates are
``groupBy`` results joined back (partial aggregation first, AQE splits a hot
key at the join). The block median is an exact per-block percentile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import BROADCAST_KEYS, beside_totals, join_back, land, window_totals
from ..functions.exprs import finite_or_zero, flag, numeric_columns
from ..functions.quantiles import grouped_quantiles
from ..functions.windows import DAY_US, WEEK_US, BucketedSequence, Cells, busy_keys, cell_bound, dealt, row_counts, trailing_counts
from ..session import checkpoint_dir
from ..sources.tables import TX_ORDER, micros

US = 1_000_000
HOUR_US = 3600 * US
TRAILING = {"tx_24h_window": DAY_US, "tx_1h_window": HOUR_US}
TRACKING = ("hash", "from_addr", "to_addr", "ts", "is_fraud")
# Token amounts are summed exactly in decimal, then turned into doubles.
MONEY = "decimal(20,6)"


def calendar_features(tx: DataFrame) -> DataFrame:
    """Hour, weekday (Monday = 0) and weekend flag."""
    return (tx.withColumn("hour_of_day", F.hour("ts"))
            .withColumn("day_of_week", F.weekday("ts"))
            .withColumn("is_weekend", flag(F.weekday("ts") >= 5)))


def _gap_and_counts(rows: DataFrame, windows: dict[str, int]) -> DataFrame:
    """``prev__t`` and the trailing counts of senders whose rows fit into one task: windows over the sender alone."""
    w = Window.partitionBy("from_addr")
    d = rows.withColumn("prev__t", F.lag("_t").over(w.orderBy("_t", *TX_ORDER[1:])))
    return d.withColumns({name: F.count(F.lit(1)).over(w.orderBy("_t").rangeBetween(-x, 0)).cast("bigint") for name, x in windows.items()})


def _busy_sequences(d: DataFrame, bucket_us: int, windows: dict[str, int], bound: int, most: int) -> DataFrame:
    """The same for busy senders: (sender, week) partitions with context copies, split cells for those with more rows
    in a week than a task should hold."""
    order = ("_t",) + TX_ORDER[1:]
    back = max(windows.values()) if windows else 0

    def framed(rows: DataFrame) -> DataFrame:
        seq = BucketedSequence.build(rows, "from_addr", "_t", order, bucket_us, back_us=back).lag_columns(["_t"])
        return seq.with_columns({name: F.count(F.lit(1)).over(seq.range(-w, 0)).cast("bigint")
                                 for name, w in windows.items()}).owned()

    heavy = Cells(d, "from_addr", "_t", bound, bucket_us).keys()
    if heavy is None:
        return framed(d)
    if not windows:
        return BucketedSequence.in_cells(d, "from_addr", "_t", order, bound, most, bucket_us).lag_columns(["_t"]).owned()
    hot = d.join(F.broadcast(heavy), "from_addr", "left_semi")  # fewer than rows / bound senders
    seq = BucketedSequence.in_cells(hot, "from_addr", "_t", order, bound, most, bucket_us).lag_columns(["_t"]).owned()
    counts = trailing_counts(hot, "from_addr", "_t", windows, bound)
    light = framed(d.join(F.broadcast(heavy), "from_addr", "left_anti"))
    return light.unionByName(seq.join(counts, ["from_addr", "_t"]).select(*light.columns))


def _sequences(tx: DataFrame, bucket_us: int, windows: dict[str, int], light_only, busy_only, nobody_only) -> DataFrame:
    """``sequence_features`` with a further step for each kind of rows: ``light_only`` on senders whose rows fit into one
    task (partitioned by sender already), ``busy_only`` on the others (a landed table), ``nobody_only`` on rows without a sender."""
    d = tx.withColumn("_t", micros("ts"))
    gap = F.coalesce((F.col("_t") - F.col("prev__t")) / F.lit(float(US)), F.lit(0.0))
    nobody = d.where(F.col("from_addr").isNull()).withColumns(
        {**{name: F.lit(0).cast("bigint") for name in windows}, "time_since_last_tx": F.lit(0.0)}).drop("_t")
    n, none = row_counts(d, "from_addr")
    d = d.where(F.col("from_addr").isNotNull())
    bound, most = cell_bound(d, "from_addr")
    if most > bound:
        checkpoint_dir(d.sparkSession)
        busy = F.broadcast(busy_keys(d, "from_addr", bound).checkpoint())
        hot, d = d.join(busy, "from_addr", "left_semi"), d.join(busy, "from_addr", "left_anti")
    out = light_only(_gap_and_counts(dealt(d, n, "from_addr"), windows).withColumn("time_since_last_tx", gap)).drop("_t", "prev__t")
    if most > bound:
        seq = _busy_sequences(hot, bucket_us, windows, bound, most).withColumn("time_since_last_tx", gap).drop("_t", "prev__t")
        out = out.unionByName(busy_only(seq).select(*out.columns))
    return out.unionByName(nobody_only(nobody).select(*out.columns)) if none else out


def sequence_features(tx: DataFrame, bucket_us: int = WEEK_US,
                      windows: dict[str, int] | None = None) -> DataFrame:
    """seconds since the sender's previous transaction (first = 0)
    and trailing counts over ``[t - w, t]`` (both ends inclusive, same-time peers
    included) for each ``name -> w`` in ``windows`` (µs). A row without a sender
    belongs to no sequence: gap and counts are 0. Senders with more rows
    than a task should hold go through buckets and split cells (``functions.windows``)."""
    windows = TRAILING if windows is None else windows
    return _sequences(tx, bucket_us, windows, lambda d: d, lambda d: d, lambda d: d)


def sequences_with_totals(tx: DataFrame, totals: dict, distinct: dict[str, str], bucket_us: int = WEEK_US,
                          windows: dict[str, int] | None = None) -> DataFrame:
    """``sequence_features`` with the sender's ``totals`` (aggregates by name) and numbers of ``distinct`` non-null values
    (name -> column) beside its rows, null without a sender. Gaps, frames and totals of all senders whose rows fit
    into one task come from one exchange by sender; nothing is joined back to them."""
    windows = TRAILING if windows is None else windows

    def beside(d: DataFrame) -> DataFrame:
        return window_totals(d, ["from_addr"], totals, distinct)

    def joined(d: DataFrame) -> DataFrame:
        d = land(d)  # gaps come from sorted sequences: not again for the join
        per = d.groupBy("from_addr").agg(*[F.count_distinct(c).cast("bigint").alias(name) for name, c in distinct.items()],
                                         *[a.alias(name) for name, a in totals.items()])
        return d.join(F.broadcast(per), "from_addr")  # fewer than rows / bound senders

    def empty(d: DataFrame) -> DataFrame:
        return d.withColumns({name: F.lit(None) for name in (*distinct, *totals)})

    return _sequences(tx, bucket_us, windows, beside, joined, empty)


def value_features(tx: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Log value, gas cost (``gasUsed`` if the column exists, else the gas
    limit; decided on the schema, not per row), value/gas ratio, zero flag."""
    used = "gas_used" if "gas_used" in tx.columns else "gas"
    return (tx.withColumn("log_value", F.log1p("value_eth"))
            .withColumn("gas_cost_eth", F.col(used) * F.col("gas_price") / F.lit(1e18))
            .withColumn("value_to_gas_ratio", F.col("value_eth") / (F.col("gas_cost_eth") + F.lit(eps)))
            .withColumn("is_zero_value", flag(F.col("value_eth") == 0)))


def gas_features(tx: DataFrame, eps: float = 1e-10, base: DataFrame | None = None) -> DataFrame:
    """Gas price in gwei, exact block median, ratio to it, efficiency
    (``gas_used / (gas + 1)`` or the constant 0.5 without a ``gas_used`` column).

    The median is exact; a block with very many rows is not held by one buffer
    (``grouped_quantiles``). A row without a block has no median. ``base``: a plain
    table with the same blocks and prices, which the medians are taken from."""
    gwei = F.col("gas_price") / F.lit(1e9)
    d = tx.withColumn("gas_price_gwei", gwei)
    known = (tx if base is None else base).select("block_number", gwei.alias("gas_price_gwei")).where(F.col("block_number").isNotNull())
    med = grouped_quantiles(known, "block_number", "gas_price_gwei", {"block_median_gas": 0.5}, count="_rows")
    d = join_back(d, med, "block_number", "_rows", ["hash"], BROADCAST_KEYS).drop("_rows")
    d = d.withColumn("gas_price_ratio", F.col("gas_price_gwei") / (F.col("block_median_gas") + F.lit(eps)))
    if "gas_used" in tx.columns:
        return d.withColumn("gas_efficiency", F.col("gas_used") / (F.col("gas") + 1))
    return d.withColumn("gas_efficiency", F.lit(0.5))


def _behaviour_totals(columns: list[str]) -> dict:
    """Aggregates over a sender's rows."""
    gap = F.nullif(F.col("time_since_last_tx"), F.lit(0.0))
    out = {"tx_interval_mean": F.avg("time_since_last_tx"), "_nonzero_mean": F.avg(gap)}
    if "is_error" in columns:
        out["_error_rate"] = F.avg("is_error")
    return out


def _behaviour_columns(d: DataFrame, burst_min: int) -> DataFrame:
    """Columns that follow from the sender's totals and the row's own gap and counts."""
    d = d.withColumn("tx_interval_mean_nonzero", F.when(F.col("from_addr").isNotNull(), F.coalesce(F.col("_nonzero_mean"), F.lit(0.0)))).drop("_nonzero_mean")
    if "_error_rate" in d.columns:
        d = d.withColumn("tx_success_rate", 1 - F.col("_error_rate")).drop("_error_rate")
    else:
        d = d.withColumn("tx_success_rate", F.lit(1.0))
    if "tx_1h_window" in d.columns:
        d = d.withColumn("burst_activity_flag", flag(F.col("tx_1h_window") > burst_min))
    return d.withColumn("rapid_followup_flag", flag(F.col("time_since_last_tx") < 60))


def sender_behaviour(tx_seq: DataFrame, burst_min: int = 10, landed: bool = False) -> DataFrame:
    """F5a, F5b, F14, F16, F18a, F18b on the output of ``sequence_features``:
    one ``groupBy(sender)`` joined back (busy senders by broadcast). ``landed``: the
    rows are a plain table already."""
    if not landed:
        tx_seq = land(tx_seq)  # gaps come from sorted sequences: not again for the join
    per = tx_seq.groupBy("from_addr").agg(
        F.count_distinct("to_addr").cast("bigint").alias("unique_receivers"),
        *[a.alias(name) for name, a in _behaviour_totals(tx_seq.columns).items()], F.count(F.lit(1)).alias("_rows"))
    d = join_back(tx_seq, per, "from_addr", "_rows", ["hash"]).drop("_rows")
    return _behaviour_columns(d, burst_min)


def sequence_behaviour(tx: DataFrame, bucket_us: int = WEEK_US, burst_min: int = 10) -> DataFrame:
    """``sender_behaviour`` of ``sequence_features`` in one exchange by sender."""
    d = sequences_with_totals(tx, _behaviour_totals(tx.columns), {"unique_receivers": "to_addr"}, bucket_us)
    return _behaviour_columns(d, burst_min)


def counterparty_aggregates(tx: DataFrame, base: DataFrame | None = None, by_sender: bool = False) -> DataFrame:
    """Sender and receiver aggregates beside the rows; nulls -> 0;
    ``counterparty_entropy`` is the receiver/transaction ratio of the original. The rows are
    exchanged once by sender (not if they lie so, ``by_sender``: results of ``detect_drainers`` and of sequences) and once by
    receiver. ``base``: a plain table with the same rows, which the sizes of the keys and the totals of busy ones are taken from;
    ``tx`` is landed first without it, or if there are busy senders and it has no drainer flags."""
    if base is not None and "suspected_drainer" in tx.columns and "suspected_drainer" not in base.columns:
        bound, most = cell_bound(base, "from_addr")
        base = None if most > bound else base
    if base is None:
        tx = base = land(tx)
        by_sender = False
    cost = F.col("gas") * F.col("gas_price") / F.lit(1e18)
    tx, base = (d if "gas_cost_eth" in d.columns else d.withColumn("gas_cost_eth", cost) for d in (tx, base))
    drainer = F.col("suspected_drainer") if "suspected_drainer" in tx.columns else F.lit(0)
    need = ["hash", "from_addr", "to_addr", "value_eth", "gas_cost_eth", *[c for c in ("suspected_drainer",) if c in base.columns]]
    snd = {"sender_tx_count": F.count("hash"), "sender_total_value": F.sum(F.col("value_eth").cast(MONEY)), "_values": F.count("value_eth"),
           "sender_value_std": F.stddev_samp("value_eth"), "sender_avg_gas_cost": F.avg("gas_cost_eth"), "sender_drainer_ratio": F.avg(drainer)}
    d = beside_totals(tx, base.select(*need), "from_addr", snd, {"sender_unique_receivers": "to_addr"}, ["hash"], by_sender)
    total = F.col("sender_total_value").cast("double")
    d = d.withColumn("sender_avg_value", F.try_divide(total, F.col("_values").cast("double"))).withColumn("sender_total_value", total)
    d = beside_totals(d.drop("_values"), base.select(*need), "to_addr", {"receiver_tx_count": F.count("hash")},
                      {"receiver_unique_senders": "from_addr"}, ["hash"])
    d = d.select(*tx.columns, "sender_tx_count", "sender_unique_receivers", "sender_total_value", "sender_avg_value", "sender_value_std",
                 "sender_avg_gas_cost", "sender_drainer_ratio", "receiver_tx_count", "receiver_unique_senders")
    for c in ("sender_tx_count", "sender_unique_receivers", "receiver_tx_count",
              "receiver_unique_senders"):
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(0)).cast("bigint"))
    for c in ("sender_total_value", "sender_avg_value", "sender_value_std",
              "sender_avg_gas_cost", "sender_drainer_ratio"):
        d = d.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return d.withColumn("counterparty_entropy",
                        F.col("sender_unique_receivers") / (F.col("sender_tx_count") + 1))


def clean_matrix(df: DataFrame, keep: tuple[str, ...] = TRACKING) -> DataFrame:
    """C5 + C6: numeric nulls -> 0, +-inf and NaN -> 0; non-numeric columns dropped
    except the tracking columns."""
    nums = set(numeric_columns(df))
    cols = []
    for c in df.columns:
        if c in keep and c not in nums:
            cols.append(F.col(c))
        elif c in nums:
            t = dict(df.dtypes)[c]
            if t in ("double", "float"):
                cols.append(finite_or_zero(c).alias(c))
            else:
                cols.append(F.coalesce(F.col(c), F.lit(0)).cast(t).alias(c))
    return df.select(*cols)


def feature_matrix(tx: DataFrame, bucket_us: int = WEEK_US, base: DataFrame | None = None) -> DataFrame:
    """calendar, sequence, value, gas and behaviour features, then C5/C6. One exchange of the rows (by sender), before
    what follows from a row alone is added to it.
    ``base``: a plain table with the same rows' blocks and gas prices, if ``tx`` is not one itself."""
    first = value_features(calendar_features(tx)).columns
    rows = value_features(calendar_features(sequence_behaviour(tx, bucket_us)))
    rows = rows.select(*first, *[c for c in rows.columns if c not in first])
    d = gas_features(rows, base=tx if base is None else base)
    d = d.drop("tx_interval_mean_nonzero", "rapid_followup_flag")
    return clean_matrix(d)


def feature_matrix_alt(tx: DataFrame, bucket_us: int = WEEK_US) -> DataFrame:
    """the notebook matrix: C1 cleaning, then the variant features
    (non-zero gap mean, 60 s follow-up flag, 1e-9 epsilon, value per gas),
    sender/receiver aggregates and numeric selection."""
    from .cleaning import clean_transactions
    landed = land(clean_transactions(tx))  # read by the sizes of the keys and by the sequences
    d = calendar_features(landed)
    d = sequences_with_totals(d, {"tx_interval_mean": F.avg(F.nullif(F.col("time_since_last_tx"), F.lit(0.0)))}, {}, bucket_us, windows={})
    d = d.withColumn("tx_interval_mean", F.when(F.col("from_addr").isNotNull(), F.coalesce("tx_interval_mean", F.lit(0.0))))
    d = d.withColumn("rapid_followup_flag", flag(F.col("time_since_last_tx") < 60))
    d = (d.withColumn("log_value", F.log1p("value_eth"))
         .withColumn("gas_price_gwei", F.col("gas_price") / F.lit(1e9))
         .withColumn("gas_cost_eth", F.col("gas") * F.col("gas_price") / F.lit(1e18))
         .withColumn("value_to_gas_ratio", F.col("value_eth") / (F.col("gas_cost_eth") + F.lit(1e-9)))
         .withColumn("is_zero_value", flag(F.col("value_eth") == 0))
         .withColumn("value_per_gas", F.col("value_eth") / (F.col("gas") + 1)))
    d = counterparty_aggregates(d, base=landed, by_sender=True)
    return clean_matrix(d)
