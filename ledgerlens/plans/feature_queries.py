"""Registered queries for features (F1-F23), cleaning (C1-C10) and sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cleaning as C
from ..operators import features as FE
from ..operators import rules as R
from ..sources import ingest as S
from ..sources.tables import events_view, read_table, scam_seed, tx_view
from .registry import EVENTS_CTE, register, with_tx
from .rule_queries import drainer_sql

SEQ_SQL = """
seq AS (SELECT tx.*,
               coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0.0) AS time_since_last_tx,
               count(*) OVER (PARTITION BY from_addr ORDER BY ts
                              RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS tx_24h_window,
               count(*) OVER (PARTITION BY from_addr ORDER BY ts
                              RANGE BETWEEN INTERVAL 1 HOURS PRECEDING AND CURRENT ROW) AS tx_1h_window
        FROM tx WINDOW w AS (PARTITION BY from_addr ORDER BY ts, block_number, tx_index, hash))"""


@register("calendar_features", with_tx("""
SELECT hash, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend
FROM tx"""))
def q_calendar(spark, sf):
    """F1-F3."""
    return FE.calendar_features(tx_view(spark, sf)).select("hash", "hour_of_day", "day_of_week", "is_weekend")


@register("sequence_features", with_tx(SEQ_SQL + """
SELECT hash, round(time_since_last_tx, 6) AS time_since_last_tx, tx_24h_window, tx_1h_window FROM seq"""))
def q_sequence(spark, sf):
    """F4, F15, F17 on the transaction view."""
    return FE.sequence_features(tx_view(spark, sf)).select(
        "hash", "time_since_last_tx", "tx_24h_window", "tx_1h_window")


@register("sequence_features_events", with_tx(SEQ_SQL + """
SELECT hash, round(time_since_last_tx, 6) AS time_since_last_tx, tx_24h_window, tx_1h_window FROM seq""",
                                              EVENTS_CTE))
def q_sequence_events(spark, sf):
    """F4, F15, F17 on events (microsecond timestamps, real spacing)."""
    return FE.sequence_features(events_view(spark, sf)).select(
        "hash", "time_since_last_tx", "tx_24h_window", "tx_1h_window")


VALUE_GAS_OUT = """hash, round(ln(1 + value_eth), 6) AS log_value, round(gas_cost_eth * 1e9, 6) AS gas_cost_gwei,
       round(value_eth / (gas_cost_eth + 1e-10), 6) AS value_to_gas_ratio,
       CASE WHEN value_eth = 0 THEN 1 ELSE 0 END AS is_zero_value,
       round(gas_price / 1e9, 6) AS gas_price_gwei, round(block_median_gas, 6) AS block_median_gas,
       round((gas_price / 1e9) / (block_median_gas + 1e-10), 6) AS gas_price_ratio"""


@register("value_gas_features", with_tx(f"""
b AS (SELECT block_number, median(gas_price / 1e9) AS block_median_gas FROM tx GROUP BY block_number),
v AS (SELECT tx.*, gas * gas_price / 1e18 AS gas_cost_eth FROM tx)
SELECT {VALUE_GAS_OUT}, CAST(0.5 AS DOUBLE) AS gas_efficiency FROM v JOIN b USING (block_number)"""))
def q_value_gas(spark, sf):
    """F6-F13a without a gas_used column (gas limit; efficiency 0.5)."""
    d = FE.gas_features(FE.value_features(tx_view(spark, sf)))
    return d.select("hash", "log_value", (F.col("gas_cost_eth") * F.lit(1e9)).alias("gas_cost_gwei"), "value_to_gas_ratio", "is_zero_value",
                    "gas_price_gwei", "block_median_gas", "gas_price_ratio", "gas_efficiency")


RECEIPTS_CTE = """r AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS hash,
              21000 + CAST(CAST(l_quantity AS BIGINT) * 100 * CAST(l_tax * 100 AS BIGINT) / 10 AS BIGINT) AS gas_used,
              CAST(21000 * l_linenumber AS BIGINT) AS cumulative_gas_used,
              CAST(l_returnflag <> 'R' AS INTEGER) AS status
       FROM lineitem)"""


@register("receipt_features", with_tx(RECEIPTS_CTE + f""",
b AS (SELECT block_number, median(gas_price / 1e9) AS block_median_gas FROM tx GROUP BY block_number),
v AS (SELECT tx.*, r.gas_used, r.cumulative_gas_used, r.status,
             r.gas_used * gas_price / 1e18 AS gas_cost_eth
      FROM tx LEFT JOIN r USING (hash))
SELECT {VALUE_GAS_OUT}, round(gas_used / (gas + 1), 6) AS gas_efficiency, gas_used, cumulative_gas_used, status
FROM v JOIN b USING (block_number)"""))
def q_receipts(spark, sf):
    """S4 + F7/F13a with a gas_used column (receipts joined by hash)."""
    tx = tx_view(spark, sf)
    d = S.with_receipts(tx, S.receipts_view(spark, sf))
    d = FE.gas_features(FE.value_features(d), base=tx)  # a hash may have two receipts
    return d.select("hash", "log_value", (F.col("gas_cost_eth") * F.lit(1e9)).alias("gas_cost_gwei"), "value_to_gas_ratio", "is_zero_value",
                    "gas_price_gwei", "block_median_gas", "gas_price_ratio", "gas_efficiency",
                    "gas_used", "cumulative_gas_used", "status")


@register("sender_behaviour", with_tx(SEQ_SQL + """,
p AS (SELECT from_addr, count(DISTINCT to_addr) AS unique_receivers, avg(time_since_last_tx) AS tx_interval_mean,
             coalesce(avg(nullif(time_since_last_tx, 0.0)), 0.0) AS tx_interval_mean_nonzero,
             1 - avg(is_error) AS tx_success_rate
      FROM seq GROUP BY from_addr)
SELECT hash, CAST(unique_receivers AS BIGINT) AS unique_receivers, round(tx_interval_mean, 6) AS tx_interval_mean,
       round(tx_interval_mean_nonzero, 6) AS tx_interval_mean_nonzero, round(tx_success_rate, 6) AS tx_success_rate,
       CASE WHEN tx_1h_window > 10 THEN 1 ELSE 0 END AS burst_activity_flag,
       CASE WHEN time_since_last_tx < 60 THEN 1 ELSE 0 END AS rapid_followup_flag
FROM seq JOIN p USING (from_addr)"""))
def q_sender_behaviour(spark, sf):
    """F5a, F5b, F14, F16, F18a, F18b."""
    d = FE.sender_behaviour(FE.sequence_features(tx_view(spark, sf)))
    return d.select("hash", "unique_receivers", "tx_interval_mean", "tx_interval_mean_nonzero",
                    "tx_success_rate", "burst_activity_flag", "rapid_followup_flag")


COUNTERPARTY_SQL = """
snd AS (SELECT from_addr, count(hash) AS sender_tx_count, count(DISTINCT to_addr) AS sender_unique_receivers,
               CAST(sum(CAST(value_eth AS DECIMAL(20,6))) AS DOUBLE) AS sender_total_value,
               CAST(sum(CAST(value_eth AS DECIMAL(20,6))) AS DOUBLE) / count(value_eth) AS sender_avg_value,
               coalesce(stddev_samp(value_eth), 0.0) AS sender_value_std,
               avg(gas * gas_price / 1e18) AS sender_avg_gas_cost,
               avg(suspected_drainer) AS sender_drainer_ratio
        FROM cp_in WHERE from_addr IS NOT NULL GROUP BY from_addr),
rcv AS (SELECT to_addr, count(hash) AS receiver_tx_count, count(DISTINCT from_addr) AS receiver_unique_senders
        FROM cp_in WHERE to_addr IS NOT NULL GROUP BY to_addr),
cp AS (SELECT cp_in.*, coalesce(sender_tx_count, 0) AS stc, coalesce(sender_unique_receivers, 0) AS sur,
              coalesce(sender_total_value, 0.0) AS stv, coalesce(sender_avg_value, 0.0) AS sav,
              coalesce(sender_value_std, 0.0) AS svs, coalesce(sender_avg_gas_cost, 0.0) AS sag,
              coalesce(sender_drainer_ratio, 0.0) AS sdr, coalesce(receiver_tx_count, 0) AS rtc,
              coalesce(receiver_unique_senders, 0) AS rus
       FROM cp_in LEFT JOIN snd USING (from_addr) LEFT JOIN rcv USING (to_addr))"""

COUNTERPARTY_OUT = """CAST(stc AS BIGINT) AS sender_tx_count, CAST(sur AS BIGINT) AS sender_unique_receivers,
       round(stv, 6) AS sender_total_value, round(sav, 6) AS sender_avg_value, round(svs, 6) AS sender_value_std,
       round(sag, 6) AS sender_avg_gas_cost, round(sdr, 6) AS sender_drainer_ratio,
       CAST(rtc AS BIGINT) AS receiver_tx_count, CAST(rus AS BIGINT) AS receiver_unique_senders,
       round(sur / (stc + 1), 6) AS counterparty_entropy"""

CP_COLS = ("sender_tx_count", "sender_unique_receivers", "sender_total_value", "sender_avg_value",
           "sender_value_std", "sender_avg_gas_cost", "sender_drainer_ratio", "receiver_tx_count",
           "receiver_unique_senders", "counterparty_entropy")


@register("counterparty_aggregates", with_tx(drainer_sql(R.RuleParams.coded()) + """,
cp_in AS (SELECT * FROM flagged),""" + COUNTERPARTY_SQL + f"""
SELECT hash, {COUNTERPARTY_OUT} FROM cp"""))
def q_counterparty(spark, sf):
    """F19-F21 (sender drainer ratio from the W1-W6 flags)."""
    tx = tx_view(spark, sf)
    d = FE.counterparty_aggregates(R.detect_drainers(tx), base=tx, by_sender=True)
    return d.select("hash", *CP_COLS)


@register("feature_matrix", with_tx(SEQ_SQL + """,
b AS (SELECT block_number, median(gas_price / 1e9) AS block_median_gas FROM tx GROUP BY block_number),
p AS (SELECT from_addr, count(DISTINCT to_addr) AS unique_receivers, avg(time_since_last_tx) AS tx_interval_mean,
             1 - avg(is_error) AS tx_success_rate FROM seq GROUP BY from_addr),
m AS (SELECT seq.*, gas * gas_price / 1e18 AS gas_cost_eth, block_median_gas, unique_receivers,
             tx_interval_mean, tx_success_rate
      FROM seq JOIN b USING (block_number) JOIN p USING (from_addr))
SELECT hash, from_addr, to_addr, block_number, tx_index, round(value_eth, 6) AS value_eth, gas, gas_price, nonce,
       is_error, CAST(hour(ts) AS INTEGER) AS hour_of_day, CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
       CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
       tx_24h_window, tx_1h_window, round(time_since_last_tx, 6) AS time_since_last_tx,
       round(ln(1 + value_eth), 6) AS log_value, round(gas_cost_eth, 6) AS gas_cost_eth,
       round(value_eth / (gas_cost_eth + 1e-10), 6) AS value_to_gas_ratio,
       CASE WHEN value_eth = 0 THEN 1 ELSE 0 END AS is_zero_value,
       round(gas_price / 1e9, 6) AS gas_price_gwei, round(block_median_gas, 6) AS block_median_gas,
       round((gas_price / 1e9) / (block_median_gas + 1e-10), 6) AS gas_price_ratio, CAST(0.5 AS DOUBLE) AS gas_efficiency,
       CAST(unique_receivers AS BIGINT) AS unique_receivers, round(tx_interval_mean, 6) AS tx_interval_mean,
       round(tx_success_rate, 6) AS tx_success_rate,
       CASE WHEN tx_1h_window > 10 THEN 1 ELSE 0 END AS burst_activity_flag
FROM m"""))
def q_feature_matrix(spark, sf):
    """the full per-transaction matrix (C5/C6 applied)."""
    return FE.feature_matrix(tx_view(spark, sf)).drop("ts")


@register("feature_matrix_alt", with_tx(drainer_sql(R.RuleParams.coded()) + """,
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
lab AS (SELECT flagged.*, CASE WHEN from_addr IN (SELECT address FROM scam)
                                 OR to_addr IN (SELECT address FROM scam) THEN 1 ELSE 0 END AS is_fraud
        FROM flagged),
sq AS (SELECT lab.*, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6, 0.0) AS gap
       FROM lab WINDOW w AS (PARTITION BY from_addr ORDER BY ts, block_number, tx_index, hash)),
im AS (SELECT from_addr, coalesce(avg(nullif(gap, 0.0)), 0.0) AS tx_interval_mean FROM sq GROUP BY from_addr),
cp_in AS (SELECT sq.*, im.tx_interval_mean FROM sq JOIN im USING (from_addr)),""" + COUNTERPARTY_SQL + f"""
SELECT hash, from_addr, to_addr, is_fraud, suspected_drainer, CAST(hour(ts) AS INTEGER) AS hour_of_day,
       CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week, CASE WHEN isodow(ts) - 1 >= 5 THEN 1 ELSE 0 END AS is_weekend,
       round(gap, 6) AS time_since_last_tx, round(tx_interval_mean, 6) AS tx_interval_mean,
       CASE WHEN gap < 60 THEN 1 ELSE 0 END AS rapid_followup_flag, round(ln(1 + value_eth), 6) AS log_value,
       round(gas_price / 1e9, 6) AS gas_price_gwei, round(gas * gas_price / 1e18, 6) AS gas_cost_eth,
       round(value_eth / (gas * gas_price / 1e18 + 1e-9), 6) AS value_to_gas_ratio,
       CASE WHEN value_eth = 0 THEN 1 ELSE 0 END AS is_zero_value,
       round(value_eth / (gas + 1), 6) AS value_per_gas, {COUNTERPARTY_OUT}
FROM cp"""))
def q_feature_matrix_alt(spark, sf):
    """the notebook matrix over cleaned, labelled transactions."""
    tx = tx_view(spark, sf)
    lab = R.known_scam_labels(R.detect_drainers(tx), scam_seed(tx), out="is_fraud")
    d = FE.feature_matrix_alt(lab)
    return d.select("hash", "from_addr", "to_addr", "is_fraud", "suspected_drainer", "hour_of_day",
                    "day_of_week", "is_weekend", "time_since_last_tx", "tx_interval_mean",
                    "rapid_followup_flag", "log_value", "gas_price_gwei", "gas_cost_eth",
                    "value_to_gas_ratio", "is_zero_value", "value_per_gas", *CP_COLS)


# ------------------------------------------------------------------ cleaning


@register("clean_transactions", with_tx("""
r AS (SELECT tx.*, row_number() OVER (PARTITION BY hash ORDER BY block_number, tx_index, ts, from_addr,
                                      to_addr, value_eth, gas, gas_price, nonce, is_error) AS rn
      FROM tx WHERE ts IS NOT NULL AND from_addr IS NOT NULL AND to_addr IS NOT NULL)
SELECT hash, from_addr, to_addr, round(coalesce(value_eth, 0.0), 6) AS value_eth FROM r WHERE rn = 1"""))
def q_clean(spark, sf):
    """Coerce, fill, drop incomplete rows, one row per hash."""
    return C.clean_transactions(tx_view(spark, sf)).select("hash", "from_addr", "to_addr", "value_eth")


ACCOUNT_SQL = """
scam AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0),
snd AS (SELECT from_addr AS Address, count(*) AS "Sent tnx", count(DISTINCT to_addr) AS "Unique Sent To Addresses",
               min(value_eth) AS "min val sent", max(value_eth) AS "max val sent",
               CAST(sum(CAST(value_eth AS DECIMAL(20,6))) AS DOUBLE) / count(value_eth) AS "avg val sent",
               CAST(sum(CAST(value_eth AS DECIMAL(20,6))) AS DOUBLE) AS "total Ether sent",
               (max(epoch_us(ts)) - min(epoch_us(ts))) / 60e6 / greatest(count(*) - 1, 1) AS "Avg min between sent tnx"
        FROM tx GROUP BY from_addr),
rcv AS (SELECT to_addr AS Address, count(*) AS "Received Tnx", count(DISTINCT from_addr) AS "Unique Received From Addresses",
               min(value_eth) AS "min value received", max(value_eth) AS "max value received",
               CAST(sum(CAST(value_eth AS DECIMAL(20,6))) AS DOUBLE) / count(value_eth) AS "avg val received",
               CAST(sum(CAST(value_eth AS DECIMAL(20,6))) AS DOUBLE) AS "total ether received"
        FROM tx GROUP BY to_addr),
acc AS (SELECT coalesce(snd.Address, rcv.Address) AS Address, snd.* EXCLUDE (Address), rcv.* EXCLUDE (Address)
        FROM snd FULL JOIN rcv ON snd.Address = rcv.Address),
acc2 AS (SELECT acc.*, c.c_mktsegment AS segment, p.p_brand AS brand,
                CASE WHEN s.address IS NOT NULL THEN 1 ELSE 0 END AS FLAG,
                coalesce("total ether received", 0.0) - coalesce("total Ether sent", 0.0) AS "total ether balance"
         FROM acc LEFT JOIN customer c ON c.c_custkey = acc.Address
                  LEFT JOIN part p ON p.p_partkey = acc.Address
                  LEFT JOIN scam s ON s.address = acc.Address)"""


def _accounts(spark, sf):
    tx = tx_view(spark, sf)
    return S.account_table(tx, spark, sf, scam_seed(tx))


@register("account_training_table", with_tx(ACCOUNT_SQL + """,
cl AS (SELECT coalesce("Sent tnx", 0) AS st, coalesce("Received Tnx", 0) AS rt,
              coalesce("Unique Received From Addresses", 0) AS urf,
              coalesce("avg val sent", 0.0) AS avs, coalesce("total ether balance", 0.0) AS teb,
              coalesce(segment, 'Unknown') AS segment, coalesce(brand, 'Unknown') AS brand, FLAG FROM acc2),
codes_s AS (SELECT segment, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INTEGER) AS seg_code
            FROM (SELECT DISTINCT segment FROM cl)),
codes_b AS (SELECT brand, CAST(dense_rank() OVER (ORDER BY brand) - 1 AS INTEGER) AS brand_code
            FROM (SELECT DISTINCT brand FROM cl))
SELECT st AS "Sent tnx", rt AS "Received Tnx", urf AS "Unique Received From Addresses",
       round(avs, 6) AS "avg val sent", round(teb, 6) AS "total ether balance",
       seg_code AS segment, brand_code AS brand, CAST(FLAG AS INTEGER) AS label
FROM cl JOIN codes_s USING (segment) JOIN codes_b USING (brand)"""))
def q_account_training(spark, sf):
    """C2 (clean), C3 (category codes), C4 (label split) on the account table."""
    acc = _accounts(spark, sf).select(
        "Address", "Sent tnx", "Received Tnx", "Unique Received From Addresses", "avg val sent",
        "total ether balance", "segment", "brand", "FLAG")
    return C.prepare_training_data(C.clean_accounts(acc))


@register("category_codes", with_tx(ACCOUNT_SQL + """,
cs AS (SELECT segment, CAST(dense_rank() OVER (ORDER BY segment) - 1 AS INTEGER) AS code
       FROM (SELECT DISTINCT segment FROM acc2 WHERE segment IS NOT NULL))
SELECT Address, coalesce(cs.code, -1) AS segment FROM acc2 LEFT JOIN cs USING (segment)"""))
def q_category_codes(spark, sf):
    """C3 with nulls (-1) left in place."""
    acc = _accounts(spark, sf).select("Address", "segment")
    return C.category_codes(acc, ["segment"])


TYPE_ROWS = [("block_number", "bigint"), ("tx_index", "int"), ("from_addr", "bigint"),
             ("to_addr", "bigint"), ("value_eth", "double"), ("gas", "bigint"),
             ("gas_price", "bigint"), ("nonce", "int"), ("is_error", "int")]


def _type_sql():
    parts = []
    for c, t in TYPE_ROWS:
        is_int = t != "double"
        rec = ("CASE WHEN mn >= -128 AND mx <= 127 THEN 'tinyint' WHEN mn >= -32768 AND mx <= 32767 THEN 'smallint' "
               "WHEN mn >= -2147483648 AND mx <= 2147483647 THEN 'int' ELSE 'bigint' END") if is_int else \
              "CASE WHEN mn >= -3.4028235e38 AND mx <= 3.4028235e38 THEN 'float' ELSE 'double' END"
        parts.append(f"SELECT '{c}' AS column_name, '{t}' AS current_type, mn AS min_value, mx AS max_value, "
                     f"{rec} AS recommended_type FROM (SELECT CAST(min({c}) AS DOUBLE) AS mn, "
                     f"CAST(max({c}) AS DOUBLE) AS mx FROM tx)")
    return "\nUNION ALL\n".join(parts)


@register("type_profile", with_tx(f"""
tp AS ({_type_sql()})
SELECT column_name, current_type, round(min_value, 6) AS min_value, round(max_value, 6) AS max_value,
       recommended_type FROM tp"""))
def q_type_profile(spark, sf):
    """Narrowest type per numeric column."""
    return C.type_profile(tx_view(spark, sf).drop("hash", "ts"))


@register("address_units", with_tx("""
SELECT hash, lower(CAST(from_addr AS VARCHAR)) AS from_addr, lower(CAST(to_addr AS VARCHAR)) AS to_addr,
       round(CAST(CAST(floor(value_eth * 1e6 + 0.5) AS HUGEINT) * 1000000000000 AS DOUBLE) / 1e18, 6) AS value_eth,
       round(gas_price / 1e9, 6) AS gas_price_gwei FROM tx"""))
def q_address_units(spark, sf):
    """C8 + C9: amounts as integers of wei first, in decimals, then as tokens again."""
    wei = F.floor(F.col("value_eth") * F.lit(1e6) + F.lit(0.5)).cast("decimal(26,0)") * F.lit(10 ** 12).cast("decimal(13,0)")
    d = C.unit_conversions(C.lower_addresses(tx_view(spark, sf).withColumn("value", wei).drop("value_eth")))
    return d.select("hash", "from_addr", "to_addr", "value_eth", "gas_price_gwei")


# ------------------------------------------------------------------- sources


@register("recent_snapshot", with_tx("""
SELECT hash, block_number, tx_index FROM tx
WHERE block_number >= (SELECT max(block_number) FROM tx) - 500
ORDER BY block_number DESC, tx_index, hash LIMIT 5000"""))
def q_snapshot(spark, sf):
    """Newest 5000 transactions of the last 501 blocks."""
    return S.recent_snapshot(tx_view(spark, sf), 5000, 500).select("hash", "block_number", "tx_index")


@register("block_range", with_tx("""
SELECT hash, block_number FROM tx WHERE block_number BETWEEN 400 AND 599"""))
def q_block_range(spark, sf):
    """Reversed bounds (900, 400) swapped, capped to 200 blocks."""
    return S.block_range(tx_view(spark, sf), 900, 400, max_blocks=200).select("hash", "block_number")


@register("address_history", with_tx("""
a AS (SELECT DISTINCT from_addr AS address FROM tx WHERE from_addr % 97 = 0)
SELECT hash, from_addr, to_addr FROM tx WHERE from_addr IN (SELECT address FROM a) AND block_number >= 100
UNION ALL
SELECT hash, from_addr, to_addr FROM tx WHERE to_addr IN (SELECT address FROM a) AND block_number >= 100"""))
def q_address_history(spark, sf):
    """History of the seed addresses from block 100 on (duplicates kept)."""
    tx = tx_view(spark, sf)
    return S.address_history(tx, scam_seed(tx), start=100).select("hash", "from_addr", "to_addr")


@register("coerce_events", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
       CAST(CAST(strptime(strftime(ts, '%Y-%m-%d %H:%M:%S'), '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS VARCHAR) AS ts_parsed,
       CAST(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT))::TIMESTAMP AS VARCHAR) AS ts_epoch
FROM events""")
def q_coerce_events(spark, sf):
    """S6 + S7: JSON text to numbers (invalid -> null), text and epoch seconds to timestamps."""
    ev = read_table(spark, sf, "events").select(
        "event_id", F.get_json_object("props", "$.k").alias("k"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_parsed"),
        F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("ts_epoch"))
    d = C.coerce_numeric(ev, ("k",), to="bigint")
    d = C.parse_timestamp(C.parse_timestamp(d, "ts_parsed"), "ts_epoch")
    return d.select("event_id", "k",
                    F.col("ts_parsed").cast("timestamp_ntz").cast("string").alias("ts_parsed"),
                    F.col("ts_epoch").cast("timestamp_ntz").cast("string").alias("ts_epoch"))


@register("scam_addresses", with_tx("""
SELECT DISTINCT lower(trim(CAST(from_addr AS VARCHAR))) AS address FROM tx WHERE from_addr % 97 = 0"""))
def q_scam_addresses(spark, sf):
    """Scam address set, lower-cased and distinct."""
    return S.scam_addresses(spark, scam_seed(tx_view(spark, sf)))
