"""Rows with nulls stay, null scores are no points, and hot keys are spread."""
from conftest import tx_rows
from pyspark.sql import functions as F

from ledgerlens.functions.joins import join_back, lookup
from ledgerlens.operators import metrics as E
from ledgerlens.operators import rules as R
from ledgerlens.operators import sampling as L


def test_rows_without_a_sender_keep_their_place(spark):
    rows = [dict(from_addr="a" if i % 3 else None, t=i * 10.0, value=float(i % 5), to_addr=f"r{i % 7}") for i in range(60)]
    tx = tx_rows(spark, rows)
    out = R.detect_drainers(tx).collect()
    assert len(out) == 60
    nobody = [r for r in out if r["from_addr"] is None]
    assert len(nobody) == 20 and all(r["sender_rows"] == 0 and r["w1_burst"] == r["w4_zero_drain"] == 0 for r in nobody)
    z = R.value_zscore_outliers(tx).collect()
    assert len(z) == 60 and all(r["prior_n"] == 0 and r["r3_value_outlier"] == 0 for r in z if r["from_addr"] is None)


def test_splits_keep_rows_with_null_keys(spark):
    df = spark.createDataFrame([(f"h{i}", None if i == 2 else float(i), None if i == 3 else i % 2) for i in range(8)],
                               "hash string, ts double, y int")
    assert L.temporal_split(df).count() == 8
    assert L.stratified_split(df, "y", "hash").count() == 8
    folds = L.stratified_kfold(df, "y", "hash", k=2).collect()
    assert len(folds) == 8 and all(r["fold"] is not None for r in folds)


def test_null_scores_are_left_out_of_curves(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (0, 0.4), (0, None), (1, 0.2), (None, 0.5)], "y int, score double")
    pts = {r["threshold"]: (r["tp"], r["fp"], r["P"], r["N"]) for r in E.curve_points(df).collect()}
    assert pts == {0.9: (1, 0, 2, 1), 0.4: (1, 1, 2, 1), 0.2: (2, 1, 2, 1)}


def test_hot_and_null_keys_are_spread(spark):
    """A third of the rows on one key and a third without a key: no task of the join holds either."""
    df = spark.range(0, 30_000, 1, 4).select(
        F.col("id").cast("string").alias("hash"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 2999)).alias("key"))
    per = df.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("hash").alias("top"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(old, ("-1", "20", "false")):
            spark.conf.set(c, v)
        out = join_back(df, per, "key", "n", ["hash"])
        sizes = [r["c"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()]
        assert sum(sizes) == 30_000 and max(sizes) < 3 * 30_000 / 20
        side = per.select("key", "top").where("key != 'hot'")
        sizes = [r["c"] for r in lookup(df.where("key is null or key != 'hot'"), side, "key", ["hash"])
                 .groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("c")).collect()]
        assert sum(sizes) == 20_000 and max(sizes) < 3 * 20_000 / 20
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)
    got = join_back(df, per, "key", "n", ["hash"])
    bad = got.join(per.withColumnRenamed("n", "n2").withColumnRenamed("top", "t2"), "key", "left") \
        .where("not (n <=> n2 and top <=> t2)").count()
    assert got.count() == 30_000 and bad == 0


def test_distance_follows_a_long_chain(spark):
    from ledgerlens.operators import graph as G
    edges = spark.createDataFrame([(i, i + 1, 1.0, 1) for i in range(40)] + [(100, 101, 1.0, 1)],
                                  "src long, dst long, weight double, tx_count long")
    got = {r["address"]: (r["distance_to_scam"], r["reachable"]) for r in
           G.scam_distance(edges, spark.createDataFrame([(40,)], "address long")).collect()}
    assert got == {**{i: (40 - i, 1) for i in range(41)}, 100: (999, 0), 101: (999, 0)}


def test_labels_settle_without_a_round_limit(spark):
    from ledgerlens.operators import graph as G
    pairs = [(a, b) for g in (range(0, 6), range(10, 16)) for a in g for b in g if a < b]
    edges = spark.createDataFrame([(a, b, 1.0, 1) for a, b in pairs], "src long, dst long, weight double, tx_count long")
    com = {r["address"]: r["community_id"] for r in G.label_propagation(edges).collect()}
    assert len({com[i] for i in range(6)}) == 1 and len(set(com.values())) == 2


def test_votes_add_up(spark):
    df = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 0, 0), (0, 0, 1)], "is_fraud_known int, suspected_drainer int, is_fraud_synthetic int")
    got = [(r["vote_confidence"], r["is_fraud_vote"]) for r in R.weighted_vote_labels(df).collect()]
    assert got == [(0.9, 1), (0.6, 0), (1.0, 1), (0.3, 0)]


def test_neighbours_are_the_nearest(spark, monkeypatch):
    """Against brute force, over many ranges, with ties and a frequent point."""
    import random

    from ledgerlens.operators import oversampling as O
    monkeypatch.setattr(O, "RANGE_POINTS", 30)
    r = random.Random(1)
    rows = [(f"p{i:03d}", int(r.random() < .4), float(r.randint(0, 20)), r.gauss(0, 5) if i % 4 else 1.0) for i in range(160)]
    rows += [(f"d{i:02d}", 1, 7.0, 1.0) for i in range(20)]
    df = spark.createDataFrame(rows, "hash string, y int, a double, b double")
    got = {}
    for x in O.nearest_neighbors(df.where("y = 1"), df, "hash", ["a", "b"], 4).collect():
        got.setdefault(x["qid"], []).append((x["nrank"], round(x["dist"], 9), x["rid"]))
    for h, y, a, b in rows:
        if y:
            want = sorted((round(((a - c) ** 2 + (b - d) ** 2) ** 0.5, 9), o) for o, _, c, d in rows if o != h)[:4]
            assert [(d, o) for _, d, o in sorted(got[h])] == want


def test_folds_oversample_training_rows_only(spark):
    from functools import partial

    from ledgerlens.operators import models as ML
    from ledgerlens.operators import oversampling as O
    rows = [(f"h{i:03d}", i, float(i % 13), float(i * 7 % 11) + 3 * (i % 6 == 0), int(i % 6 == 0)) for i in range(180)]
    df = spark.createDataFrame(rows, "hash string, ts long, a double, b double, y int")
    seen, sizes = [], []

    def watched(how):
        def run(train, *args):
            seen.append({r["hash"] for r in train.collect()})
            return how(train, *args)
        return run

    def logistic(n):
        sizes.append(n)
        return ML.logistic(n=n)

    per = ML.time_series_cv(df, ["a", "b"], "y", logistic, n_splits=2, resample=watched(O.adasyn)).collect()
    assert len(per) == 2 and seen == [{f"h{i:03d}" for i in range(n)} for n in (60, 120)]
    assert all(n > 1.4 * len(s) for n, s in zip(sizes, seen))  # one in six is positive; ADASYN fills up to about parity
    plain = ML.time_series_cv(df, ["a", "b"], "y", ML.logistic, n_splits=2, resample=None).collect()
    assert [r["recall"] for r in per] != [r["recall"] for r in plain]
    seen.clear(), sizes.clear()
    folds = ML.kfold_cv(df, ["a", "b"], "y", logistic, k=3, resample=watched(partial(O.smote, sampling_ratio=0.35))).collect()
    assert [r["fold"] for r in folds] == [0, 1, 2] and all(0.5 < r["roc_auc"] <= 1 for r in folds)
    assert all(len(s) == 120 for s in seen) and sizes == [135] * 3  # 100 of class 0, 20 + 15 of class 1
    assert not set.intersection(*seen)


def test_saved_models_carry_names_and_parameters(spark, tmp_path):
    from ledgerlens.operators import models as ML
    from ledgerlens.sources import sinks
    df = spark.createDataFrame([(f"h{i}", float(i % 7), float(i), int(i > 20)) for i in range(40)], "hash string, a double, b double, y int")
    model = ML.fit(df, ["a", "b"], "y", ML.logistic(n=40), scale=True)
    out = sinks.save_model(model, str(tmp_path), ["a", "b"])
    info = spark.read.json(out + "_info").first()
    assert info["feature_names"] == ["a", "b"] and any(k.endswith("regParam") for k in info["parameters"].asDict())
    assert ML.score(model, df, "y").where("pred = y").count() > 30
