"""Distributed helpers against plain Spark / numpy on random data."""
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.quantiles import quantile_values
from ledgerlens.functions.ranking import row_number_by
from ledgerlens.functions.windows import BucketedSequence
from ledgerlens.operators.features import sequence_features
from ledgerlens.sources.tables import micros

from conftest import tx_rows


@pytest.mark.parametrize("q", [0.0, 0.02, 0.1, 0.5, 0.9, 0.95, 1.0])
def test_exact_quantiles_match_numpy(spark, q):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.exponential(5, 3000), np.zeros(200), np.full(50, 3.25)])
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = quantile_values(df, [("a", "v", q)])["a"]
    assert got == pytest.approx(float(np.percentile(vals, 100 * q)), rel=1e-12, abs=1e-12)


def test_exact_quantiles_sketch_path(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(0, 1, 5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    got = quantile_values(df, [("a", "v", 0.95), ("b", "v", 0.1)], accuracy=1000)
    assert got["a"] == pytest.approx(float(np.percentile(vals, 95)), rel=1e-12)
    assert got["b"] == pytest.approx(float(np.percentile(vals, 10)), rel=1e-12)


def test_empty_quantile_is_none(spark):
    df = spark.createDataFrame([], "v double")
    assert quantile_values(df, [("a", "v", 0.5)])["a"] is None


def test_bucketed_sequence_equals_plain_windows(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(5):
        t = 0.0
        for _ in range(80):
            t += float(rng.choice([0, 5, 30, 400, 3000, 20000]))
            rows.append({"from_addr": f"s{s}", "t": t})
    df = tx_rows(spark, rows)
    # one-hour buckets force many frames across bucket ends
    got = sequence_features(df, bucket_us=3600 * 10**6,
                            windows={"c30m": 1800 * 10**6, "c1h": 3600 * 10**6})
    d = df.withColumn("_t", micros("ts"))
    w = Window.partitionBy("from_addr").orderBy("_t", "block_number", "tx_index", "hash")
    exp = d.select("hash",
                   F.coalesce((F.col("_t") - F.lag("_t").over(w)) / 1e6, F.lit(0.0)).alias("gap"),
                   F.count("*").over(Window.partitionBy("from_addr").orderBy("_t")
                                     .rangeBetween(-1800 * 10**6, 0)).alias("e30"),
                   F.count("*").over(Window.partitionBy("from_addr").orderBy("_t")
                                     .rangeBetween(-3600 * 10**6, 0)).alias("e1h"))
    j = got.join(exp, "hash").collect()
    assert len(j) == len(rows)
    for r in j:
        assert r["time_since_last_tx"] == pytest.approx(r["gap"])
        assert r["c30m"] == r["e30"] and r["c1h"] == r["e1h"]


def test_prefix_sums_equal_running_sums(spark):
    rows = [{"from_addr": "a", "t": i * 1000.0, "value": float(i % 7)} for i in range(200)]
    df = tx_rows(spark, rows).withColumn("_t", micros("ts"))
    seq = BucketedSequence.build(df, "from_addr", "_t", ("_t", "hash"), 3600 * 10**6).prefix_sums(
        {"s": F.col("value_eth")})
    got = {r["hash"]: r["s"] for r in seq.owned().collect()}
    acc = 0.0
    for i in range(200):
        assert got[f"h{i:04d}"] == pytest.approx(acc)
        acc += float(i % 7)


def test_row_number_by_equals_row_number(spark):
    rng = np.random.default_rng(5)
    data = [(int(g), float(rng.integers(0, 50)), f"k{i}") for i, g in enumerate(rng.integers(0, 3, 2000))]
    df = spark.createDataFrame(data, "g int, v double, k string")
    got = row_number_by(df, ["v", "k"], by=["g"], out="rn", buckets=16)
    exp = df.withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy("v", "k")))
    bad = got.join(exp, ["g", "v", "k"]).where(F.col("rn") != F.col("e")).count()
    assert bad == 0


def test_hot_sender_is_spread_and_exact(spark):
    """A sender with a third of all rows lands in many (sender, week) partitions
    and the rule flags / gaps still equal a plain per-sender window."""
    from ledgerlens.operators.rules import detect_drainers
    rows = []
    for i in range(300):  # hot sender: every ~9 hours for ~16 weeks
        rows.append({"from_addr": "hot", "t": i * 32400.0 + (i % 3) * 20, "value": float(i % 5),
                     "nonce": i + (7 if i % 50 == 0 else 0), "to_addr": f"r{i % 40}"})
    for s in range(20):
        for j in range(30):
            rows.append({"from_addr": f"s{s}", "t": j * 50000.0 + s, "value": 1.0, "to_addr": "x"})
    df = tx_rows(spark, rows)
    d = df.withColumn("_t", micros("ts"))
    seq = BucketedSequence.build(d, "from_addr", "_t", ("_t", "hash"), 7 * 86400 * 10**6)
    n_parts = seq.df.where("from_addr = 'hot'").select("_pb").distinct().count()
    assert n_parts >= 10
    got = {r["hash"]: r for r in detect_drainers(df).collect()}
    w = Window.partitionBy("from_addr").orderBy("_t", "block_number", "tx_index", "hash")
    exp = d.select("hash", (F.col("nonce") - F.lag("nonce").over(w) > 5).alias("jump")).collect()
    for r in exp:
        assert got[r["hash"]]["w5_nonce_jump"] == (1 if r["jump"] else 0)


def test_grouped_exact_quantiles_match_numpy(spark):
    from ledgerlens.functions.quantiles import exact_quantile_expr_table
    rng = np.random.default_rng(9)
    data = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 1500), rng.gamma(2.0, 3.0, 1500))]
    df = spark.createDataFrame(data, "g int, v double")
    got = {r["g"]: r for r in exact_quantile_expr_table(
        df, [("p25", "v", 0.25), ("p50", "v", 0.5), ("p90", "v", 0.9)], by=["g"]).collect()}
    for g in range(3):
        vals = np.array([v for gg, v in data if gg == g])
        for name, q in (("p25", 25), ("p50", 50), ("p90", 90)):
            assert got[g][name] == pytest.approx(float(np.percentile(vals, q)), rel=1e-12)


def test_entropy_change_by_block(spark):
    import math
    from ledgerlens.operators.rules import counterparty_entropy_change
    # block 0: receivers a, a (entropy 0); block 1: a, b (entropy ln 2)
    rows = [{"from_addr": "s", "t": i, "to_addr": r} for i, r in enumerate(["a", "a", "a", "b"])]
    out = {r["tx_block"]: r for r in counterparty_entropy_change(tx_rows(spark, rows), window_size=2).collect()}
    assert out[0]["entropy"] == pytest.approx(0.0) and out[0]["entropy_change"] is None
    assert out[1]["entropy"] == pytest.approx(math.log(2))
    assert out[1]["entropy_change"] == pytest.approx(math.log(2)) and out[1]["r5_entropy_shift"] == 1


@pytest.mark.parametrize("bound", [10**9, 500, 10])
def test_groups_of_every_size_and_null_groups(spark, bound):
    """One group holds a third of all rows, some are tiny, some rows have no group, some no value."""
    from ledgerlens.functions.quantiles import grouped_quantiles
    rng = np.random.default_rng(9)
    rows = []
    for i in range(3000):
        g = "hot" if i % 3 == 0 else None if i % 11 == 1 else f"g{i % 400}" if i % 5 else "n"
        v = None if i % 17 == 0 else float("nan") if i % 19 == 0 else float(rng.integers(0, 40)) / 4
        rows.append((g, v))
    rows += [("empty", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in grouped_quantiles(df, "g", "v", {"a": 0.5, "b": 0.9}, bound=bound, count="n").collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).append(v)
    assert set(got) == set(groups)
    for g, vs in groups.items():
        real = [v for v in vs if v is not None and v == v]
        assert got[g]["n"] == len(vs)
        for name, q in (("a", 50), ("b", 90)):
            assert got[g][name] is None if not real else got[g][name] == pytest.approx(np.percentile(real, q))


def test_classes_without_a_label_have_quartiles(spark):
    from ledgerlens.operators import profile as P
    df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, float(i)) for i in range(90)], "y int, v double")
    d = {r["y"]: r for r in P.describe_by_class(df, "v", "y").collect()}
    b = {r["y"]: r for r in P.box_stats(df, "v", "y").collect()}
    assert set(d) == set(b) == {None, 1, 2}
    for y, r in d.items():
        vs = [float(i) for i in range(90) if i % 3 == (y or 0)]
        assert (r["count"], r["p25"], r["p50"], r["p75"]) == (30, *np.percentile(vs, [25, 50, 75]))
        assert (b[y]["q1"], b[y]["median"], b[y]["whisker_low"], b[y]["whisker_high"]) == (r["p25"], r["p50"], vs[0], vs[-1])


def test_one_block_with_a_third_of_the_rows(spark, monkeypatch):
    from ledgerlens.functions import quantiles as Q
    from ledgerlens.operators import features as FE
    monkeypatch.setattr(Q, "BUFFER_ROWS", 20)
    rows = [dict(from_addr="a", t=i, block=7 if i % 3 == 0 else i // 5, gas_price=1_000_000_000 + (i * 37) % 101 * 1_000_000) for i in range(300)]
    got = FE.gas_features(tx_rows(spark, rows)).collect()
    blocks = {}
    for r in got:
        blocks.setdefault(r["block_number"], []).append(r["gas_price"] / 1e9)
    assert len(got) == 300 and all(r["block_median_gas"] == pytest.approx(np.median(blocks[r["block_number"]])) for r in got)


def test_dictionary_codes_of_many_values(spark):
    """A million distinct strings are ranked without a window over all of them."""
    from ledgerlens.functions.ranking import dense_codes
    n = 1_000_000
    df = spark.range(n).select(F.concat(F.lit("v"), F.reverse(F.col("id").cast("string"))).alias("s"))
    got = dense_codes(df.unionByName(df.limit(1000)), "s").cache()
    r = got.agg(F.count(F.lit(1)), F.count_distinct("code"), F.min("code"), F.max("code")).first()
    assert tuple(r) == (n, n, 0, n - 1)
    some = [x["s"] for x in df.where("id % 99991 = 0").collect()]
    want = sorted(f"v{str(i)[::-1]}" for i in range(n))
    place = {s: i for i, s in enumerate(want)}
    assert {x["s"]: x["code"] for x in got.where(F.col("s").isin(some)).collect()} == {s: place[s] for s in some}


def test_category_codes_with_nulls_and_accents(spark):
    from ledgerlens.operators.cleaning import category_codes
    vals = ["b", None, "a", "é", "Z", "", "b"]
    got = [r["c"] for r in category_codes(spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, c string")).orderBy("i").collect()]
    rank = {v: i for i, v in enumerate(sorted({v for v in vals if v is not None}, key=str.encode))}
    assert got == [-1 if v is None else rank[v] for v in vals]
