"""Rows of senders that fit into one task are exchanged once; totals stand beside the rows without a join."""

import re

from pyspark.sql import functions as F

from ledgerlens.functions import windows
from ledgerlens.functions.joins import beside_totals
from ledgerlens.operators import cleaning, features, rules, sampling

from conftest import tx_rows


def exchanges(df):
    """Shuffles by hash in the physical plan."""
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def some_rows(spark, n=400, senders=12, nulls=True):
    rows = [dict(from_addr=None if nulls and i % 37 == 0 else f"s{i * i % senders}", to_addr=None if nulls and i % 41 == 0 else f"r{i % 7}",
                 t=(i * 7919) % 5_000_000, value=float(i % 5), nonce=i % 9, hash=f"h{i % (n - 3):04d}") for i in range(n)]
    return tx_rows(spark, rows)


def test_sequences_and_behaviour_take_one_exchange(spark):
    tx = some_rows(spark, nulls=False)
    assert exchanges(features.sequence_behaviour(tx)) == 1
    assert exchanges(rules.light_sequence(tx.withColumn("_t", F.unix_micros(F.col("ts").cast("timestamp"))), 1000, F.lit(True))) == 1


def test_matrix_is_the_same_with_busy_senders(spark, monkeypatch):
    tx = some_rows(spark)
    plain = {"m": features.feature_matrix(tx), "d": rules.detect_drainers(tx), "c": features.counterparty_aggregates(tx)}
    want = {k: sorted(map(str, d.select(*sorted(d.columns)).collect())) for k, d in plain.items()}
    monkeypatch.setattr(windows, "MIN_CELL_ROWS", 20)
    busy = {"m": features.feature_matrix(tx), "d": rules.detect_drainers(tx), "c": features.counterparty_aggregates(tx)}
    for k, d in busy.items():
        got = sorted(map(str, d.select(*sorted(d.columns)).collect()))
        assert len(got) == 400
        if k != "c":
            assert got == want[k]
        else:  # sums of doubles may differ in the last place
            assert [re.sub(r"(\d\.\d{9})\d+", r"\1", x) for x in got] == [re.sub(r"(\d\.\d{9})\d+", r"\1", x) for x in want[k]]


def test_totals_beside_rows_equal_group_by(spark):
    tx = some_rows(spark)
    got = beside_totals(tx, tx, "from_addr", {"n": F.count("hash")}, {"u": "to_addr"}, ["hash"])
    per = {r["from_addr"]: (r["n"], r["u"]) for r in tx.groupBy("from_addr").agg(F.count("hash").alias("n"), F.count_distinct("to_addr").alias("u")).collect()}
    assert got.count() == 400
    assert all((r["n"], r["u"]) == ((None, None) if r["from_addr"] is None else per[r["from_addr"]]) for r in got.collect())


def test_scam_labels_by_broadcast(spark):
    tx = some_rows(spark)
    d = rules.known_scam_labels(tx, spark.createDataFrame([("s1",), ("r2",), (None,)], "address string"))
    assert "Exchange hashpartitioning" not in d._jdf.queryExecution().executedPlan().toString()
    assert all(r["is_fraud_known"] == int(r["from_addr"] == "s1" or r["to_addr"] == "r2") for r in d.collect())


def test_cleaning_sends_a_row_once(spark):
    plan = cleaning.clean_transactions(some_rows(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan


def test_temporal_split_orders_only_rows_near_the_cut(spark):
    tx = some_rows(spark, nulls=False)
    d = sampling.temporal_split(tx)
    assert exchanges(d) == 0
    rows = sorted((r["ts"], r["hash"], r["is_test"]) for r in d.collect())
    assert [x for _, _, x in rows] == [0] * 320 + [1] * 80
    same = sampling.temporal_split(spark.createDataFrame([(1, "a")] * 10, "ts int, hash string"))
    assert same.agg(F.sum("is_test")).first()[0] == 2


def test_round_scores_equal_the_ordered_rows(spark, monkeypatch):
    from ledgerlens.operators import models
    rows = [((i * 37) % 101 / 10.0, float(i % 4), int((i * 13) % 11 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    nodes = spark.createDataFrame([row for t in range(5) for row in ((t, 0, t % 2, 2.0 + t % 2, 1, 2, 0.0, 3.0, 3, 1.0), (t, 1, 0, 1.0 + t, 3, 4, 0.0, 2.0, 2, 1.0),
                                   (t, 2, -1, None, -1, -1, 0.1 * t, 1.0, 1, None), (t, 3, -1, None, -1, -1, -0.2, 1.0, 1, None), (t, 4, -1, None, -1, -1, 0.05, 1.0, 1, None))],
                                  "tree int, node int, feature int, threshold double, left_child int, right_child int, value double, cover double, n_rows bigint, gain double")

    def curve(values):
        monkeypatch.setattr(models, "ROUND_VALUES", values)
        return {r["round"]: r["pr_auc"] for r in models.round_scores(df, nodes, ["a", "b"], "y").collect()}

    want = curve(1)  # positives too many: all rows ordered
    assert len(want) == 5
    for values in (60, 8_000_000):  # two rounds a broadcast, all rounds
        got = curve(values)
        assert got.keys() == want.keys() and all(abs(got[r] - want[r]) < 1e-12 for r in want)


def test_counterparties_of_flagged_rows_take_two_exchanges(spark):
    tx = some_rows(spark, nulls=False)
    d = features.counterparty_aggregates(rules.detect_drainers(tx), base=tx, by_sender=True)
    assert exchanges(d) == 2  # by sender for flags and totals, by receiver
    assert exchanges(features.counterparty_aggregates(tx, base=tx)) == 2
    want = features.counterparty_aggregates(rules.detect_drainers(tx))
    near = lambda x: sorted(re.sub(r"(\d\.\d{9})\d+", r"\1", str(r)) for r in x.select(*sorted(x.columns)).collect())
    assert near(d) == near(want)


def test_tables_larger_than_the_partitions_get_more_of_them(spark, monkeypatch):
    tx = some_rows(spark)
    want = {k: sorted(map(str, f(tx).collect())) for k, f in (("m", features.feature_matrix), ("d", rules.detect_drainers))}
    monkeypatch.setattr(windows, "TASK_ROWS", 20)
    for k, f in (("m", features.feature_matrix), ("d", rules.detect_drainers), ("c", features.counterparty_aggregates)):
        assert re.search(r"hashpartitioning\(from_addr#\d+(, _bt_s#\d+)?, 20\)", f(tx)._jdf.queryExecution().executedPlan().toString()), k
        assert k not in want or sorted(map(str, f(tx).collect())) == want[k]


def test_busy_senders_are_flagged_without_flags_in_the_base(spark, monkeypatch):
    tx = some_rows(spark)
    monkeypatch.setattr(windows, "MIN_CELL_ROWS", 20)
    got = features.counterparty_aggregates(rules.detect_drainers(tx), base=tx, by_sender=True).collect()
    share = {r["from_addr"]: r["x"] for r in rules.detect_drainers(tx).groupBy("from_addr").agg(F.avg("suspected_drainer").alias("x")).collect()}
    assert len(got) == 400 and any(share.values())
    assert all(abs(r["sender_drainer_ratio"] - (0 if r["from_addr"] is None else share[r["from_addr"]])) < 1e-12 for r in got)
