"""Micro tables for the traps of the rule and feature operators."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import features as FE
from ledgerlens.operators import rules as R
from ledgerlens.operators.cleaning import category_codes, clean_accounts, clean_transactions

from conftest import tx_rows


def by_hash(df, col):
    return {r["hash"]: r[col] for r in df.select("hash", col).collect()}


def test_same_timestamp_peers(spark):
    df = tx_rows(spark, [{"from_addr": "a", "t": 0}, {"from_addr": "a", "t": 0}, {"from_addr": "a", "t": 100}])
    got = by_hash(FE.sequence_features(df), "tx_24h_window")
    assert [got[h] for h in ("h0000", "h0001", "h0002")] == [2, 2, 3]


def test_window_ends_inclusive(spark):
    day = 86400
    df = tx_rows(spark, [{"from_addr": "a", "t": 0}, {"from_addr": "a", "t": day},
                         {"from_addr": "a", "t": day + 1e-6}])
    got = by_hash(FE.sequence_features(df), "tx_24h_window")
    assert [got[h] for h in ("h0000", "h0001", "h0002")] == [1, 2, 2]


@pytest.mark.parametrize("gap,expected", [(59, 1), (60, 0)])
def test_burst_boundary(spark, gap, expected):
    df = tx_rows(spark, [{"from_addr": "a", "t": i * gap, "to_addr": "b"} for i in range(5)])
    got = by_hash(R.detect_drainers(df), "w1_burst")
    assert set(got.values()) == {expected}


def test_burst_not_adjacent(spark):
    ts = [0, 10, 20, 10019, 10029, 10039]
    df = tx_rows(spark, [{"from_addr": "a", "t": t, "to_addr": "b"} for t in ts])
    assert set(by_hash(R.detect_drainers(df), "w1_burst").values()) == {1}


def _zero_drain(spark, follower_offset):
    rows = [{"from_addr": "z", "t": 0, "value": 0.0, "to_addr": "x"},
            {"from_addr": "z", "t": follower_offset, "value": 1000.0, "to_addr": "x"}]
    rows += [{"from_addr": f"o{i}", "t": 10 * i, "value": 1.0 + i % 3, "to_addr": "y"} for i in range(40)]
    return by_hash(R.detect_drainers(tx_rows(spark, rows)), "w4_zero_drain")


def test_zero_then_drain_window_end(spark):
    got = _zero_drain(spark, 600)
    assert got["h0000"] == 1 and got["h0001"] == 1


def test_zero_then_drain_just_outside(spark):
    got = _zero_drain(spark, 600 + 1e-6)
    assert got["h0000"] == 0 and got["h0001"] == 0


def test_zero_then_drain_same_time(spark):
    got = _zero_drain(spark, 0)
    assert got["h0000"] == 0 and got["h0001"] == 0


def test_zero_then_drain_spread(spark):
    rows = [{"from_addr": "z", "t": 0, "value": 0.0}, {"from_addr": "z", "t": 100, "value": 0.5},
            {"from_addr": "z", "t": 200, "value": 1000.0}]
    rows += [{"from_addr": f"o{i}", "t": 10 * i, "value": 1.0} for i in range(40)]
    got = R.detect_drainers(tx_rows(spark, rows))
    got = by_hash(got, "w4_zero_drain")
    assert got["h0000"] == got["h0001"] == got["h0002"] == 1


def test_strict_quantile_not_flagged(spark):
    # 21 values 0..20: q95 = 19; value 19 is not above it, value 20 is
    rows = [{"from_addr": f"s{i}", "t": i, "value": float(i), "gas_price": 1} for i in range(21)]
    rows[0]["gas_price"] = 1
    df = tx_rows(spark, rows).withColumn("gas_price", F.when(F.col("value_eth") >= 19, F.lit(0))
                                         .otherwise(F.lit(5)).cast("bigint"))
    got = by_hash(R.detect_drainers(df), "w2_value_gas")
    assert got["h0019"] == 0 and got["h0020"] == 1


def test_constant_gas_price_no_point(spark):
    rows = [{"from_addr": f"s{i}", "t": i, "gas_price": 7} for i in range(10)]
    scored = R.anomaly_score(R.detect_drainers(tx_rows(spark, rows)))
    assert {r["w8_gas_outlier"] for r in scored.collect()} == {0}


def test_label_ties(spark):
    scored = spark.createDataFrame([(f"h{i}", 1 if i == 19 else 0) for i in range(20)],
                                   "hash string, anomaly_score int")
    lab = R.threshold_labels(scored, 0.05)
    assert lab.where("is_fraud_synthetic = 1").count() == 1


def test_one_row_sender(spark):
    df = tx_rows(spark, [{"from_addr": "solo", "t": 5}])
    seq = FE.sender_behaviour(FE.sequence_features(df))
    r = seq.collect()[0]
    assert r["time_since_last_tx"] == 0.0 and r["tx_interval_mean"] == 0.0
    cp = FE.counterparty_aggregates(df).collect()[0]
    assert cp["sender_value_std"] == 0.0
    assert R.detect_drainers(df).collect()[0]["w3_fanout"] == 0


def test_null_receiver_not_counted(spark):
    df = tx_rows(spark, [{"from_addr": "a", "t": 0, "to_addr": None}, {"from_addr": "a", "t": 1, "to_addr": "b"}])
    cp = FE.counterparty_aggregates(df).collect()
    assert {r["sender_unique_receivers"] for r in cp} == {1}


def test_gas_used_branch_is_schema_based(spark):
    df = tx_rows(spark, [{"from_addr": "a", "t": 0, "gas": 100, "gas_price": 10}])
    no_col = FE.value_features(df).collect()[0]
    with_null = FE.value_features(df.withColumn("gas_used", F.lit(None).cast("bigint"))).collect()[0]
    assert no_col["gas_cost_eth"] == pytest.approx(100 * 10 / 1e18)
    assert with_null["gas_cost_eth"] is None
    assert FE.gas_features(df).collect()[0]["gas_efficiency"] == 0.5


def test_label_policy_falls_back_to_synthetic(spark):
    rows = [{"from_addr": f"s{i % 4}", "t": i * 30, "value": float(i)} for i in range(40)]
    tx = tx_rows(spark, rows)
    empty = spark.createDataFrame([], "address string")
    lab = R.label_transactions(tx, empty)
    assert lab.where("is_fraud != is_fraud_synthetic").count() == 0
    known = spark.createDataFrame([("s1",)], "address string")
    lab2 = R.label_transactions(tx, known)
    assert lab2.where("is_fraud != is_fraud_known").count() == 0


def test_category_codes(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "id int, c string")
    got = {r["id"]: r["c"] for r in category_codes(df, ["c"]).collect()}
    assert got == {1: 1, 2: 0, 3: -1, 4: 1}


def test_clean_accounts_fills(spark):
    df = spark.createDataFrame([(1, None, float("inf"), None, 1.0)],
                               "Index int, a double, b double, s string, FLAG double")
    r = clean_accounts(df).collect()[0]
    assert "Index" not in r.asDict() and r["a"] == 0.0 and r["b"] == 0.0 and r["s"] == "Unknown"
    assert r["FLAG"] == 1


def test_clean_transactions_dedupes(spark):
    df = tx_rows(spark, [{"from_addr": "a", "t": 0, "hash": "x", "block": 2},
                         {"from_addr": "a", "t": 0, "hash": "x", "block": 1},
                         {"from_addr": None, "t": 0, "hash": "y"}])
    out = clean_transactions(df).collect()
    assert len(out) == 1 and out[0]["block_number"] == 1
