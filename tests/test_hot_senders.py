"""Senders with very many rows in a short time: split cells against plain windows."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import tx_rows
from ledgerlens.functions import windows as W
from ledgerlens.operators import rules as R
from ledgerlens.operators.features import sequence_features
from ledgerlens.sources.tables import micros

N = 3000


@pytest.fixture(scope="module")
def tx(spark):
    """A third of all rows are one sender's within an hour (many at one instant), and a few have no sender."""
    rng = np.random.default_rng(4)
    rows = []
    for i in range(N):
        if i % 3 == 0:
            sender, t = "hot", 9 * 86400 + float(rng.integers(0, 3600 * 4)) / 4 if i % 9 else 9 * 86400 + 1800.0
        elif i % 101 == 1:
            sender, t = None, float(rng.integers(0, 30 * 86400))
        else:
            sender, t = f"s{i % 37}", float(rng.integers(0, 30 * 86400))
        rows.append(dict(from_addr=sender, t=t, block=i % 50, idx=i, value=0.0 if rng.random() < .1 else float(rng.integers(1, 100)),
                         nonce=int(rng.integers(0, 30)), to_addr=f"r{rng.integers(0, 9)}"))
    return tx_rows(spark, rows).cache()


def test_cells_hold_few_rows_and_keep_their_order(tx):
    d = tx.where("from_addr is not null").withColumn("_t", micros("ts"))
    cells = W.Cells(d, "from_addr", "_t", 100)
    assert {r["from_addr"] for r in cells.keys().collect()} == {"hot"}
    got = cells.assign(d, "_t").groupBy("from_addr", "_cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("_t").alias("low"), F.max("_t").alias("high")).orderBy("from_addr", "_cell").collect()
    assert sum(r["n"] for r in got) == d.count() and all(r["n"] <= 100 or r["low"] == r["high"] for r in got)
    for a, b in zip(got, got[1:]):
        assert a["from_addr"] != b["from_addr"] or a["high"] < b["low"]


def test_largest_task_is_near_the_mean(spark, tx, monkeypatch):
    monkeypatch.setattr(W, "MIN_CELL_ROWS", 20)
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    old = {c: spark.conf.get(c) for c in names}
    try:
        for c, v in zip(names, ("10", "false")):
            spark.conf.set(c, v)
        # No two rows at one instant: an instant cannot be split.
        d = tx.where("from_addr is not null").dropDuplicates(["from_addr", "ts"]).withColumn("_t", micros("ts"))
        bound, most = W.cell_bound(d, "from_addr")
        seq = W.BucketedSequence.in_cells(d, "from_addr", "_t", ("_t", "block_number", "tx_index", "hash"), bound, most)
        w = seq.rows()
        sizes = [r["c"] for r in seq.df.withColumn("p", F.lag("_t").over(w)).groupBy(F.spark_partition_id().alias("q")).agg(F.count(F.lit(1)).alias("c")).collect()]
        assert most > bound and max(sizes) <= 3 * d.count() / 10
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


@pytest.mark.parametrize("bound", [10**9, 200, 40])
def test_gaps_and_counts_equal_plain_windows(tx, monkeypatch, bound):
    monkeypatch.setattr(W, "MIN_CELL_ROWS", bound)
    monkeypatch.setattr(W, "cell_bound", W.cell_bound)
    import ledgerlens.operators.features as FE
    monkeypatch.setattr(FE, "cell_bound", lambda d, k: (bound, W.cell_bound(d, k)[1]))
    got = sequence_features(tx)
    w = Window.partitionBy("from_addr").orderBy("_t", "block_number", "tx_index", "hash")
    trail = Window.partitionBy("from_addr").orderBy("_t")
    want = tx.where("from_addr is not null").withColumn("_t", micros("ts")).select(
        "hash", F.coalesce((F.col("_t") - F.lag("_t").over(w)) / 1e6, F.lit(0.0)).alias("gap"),
        F.count("*").over(trail.rangeBetween(-W.DAY_US, 0)).alias("day"), F.count("*").over(trail.rangeBetween(-W.DAY_US // 24, 0)).alias("hour"))
    rows = {r["hash"]: r for r in got.collect()}
    assert len(rows) == N
    for r in want.collect():
        g = rows.pop(r["hash"])
        assert (g["time_since_last_tx"], g["tx_24h_window"], g["tx_1h_window"]) == (r["gap"], r["day"], r["hour"])
    assert rows and all((g["from_addr"], g["time_since_last_tx"], g["tx_24h_window"], g["tx_1h_window"]) == (None, 0.0, 0, 0) for g in rows.values())
    only = {r["hash"]: r["time_since_last_tx"] for r in sequence_features(tx, windows={}).collect()}
    assert only == {r["hash"]: r["time_since_last_tx"] for r in got.collect()}


@pytest.mark.parametrize("params", [R.RuleParams.coded(), R.RuleParams.declared()])
def test_rules_do_not_depend_on_the_cells(tx, monkeypatch, params):
    def flags(bound):
        monkeypatch.setattr(R, "cell_bound", lambda d, k: (bound, W.cell_bound(d, k)[1]))
        d = R.detect_drainers(tx, params).select("hash", "w1_burst", "w4_zero_drain", "w5_nonce_jump").collect()
        z = R.value_zscore_outliers(tx).select("hash", "prior_n", "r3_value_outlier", F.round("value_z", 6).alias("z")).collect()
        e = R.counterparty_entropy_change(tx, 20).select("from_addr", "tx_block", "n_tx", F.round("entropy", 9).alias("e")).collect()
        return tuple(sorted(map(tuple, x), key=str) for x in (d, z, e))

    whole = flags(10**9)
    assert flags(60) == whole and sum(r[2] for r in whole[0]) > 100


def test_null_senders_are_no_sequence(spark):
    """Four rows without a sender get gap 0 wherever the week's border lies."""
    tx = tx_rows(spark, [dict(from_addr=None, t=t) for t in (0.0, 30.0, 19 * 86400.0, 19 * 86400.0 + 60)])
    assert {(r["time_since_last_tx"], r["tx_1h_window"]) for r in sequence_features(tx).collect()} == {(0.0, 0)}
