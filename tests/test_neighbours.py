"""Messages along packed neighbours: what they bring, and that the pairs stay where they are."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph as G
from ledgerlens.operators import neighbours as N


@pytest.mark.parametrize("weighted", [False, True])
def test_messages_come_from_every_neighbour_and_pairs_are_not_shuffled(spark, monkeypatch, weighted):
    """A hub in several rows; a state dealt like the pairs meets them without an exchange."""
    monkeypatch.setattr(N, "ROW_ENDS", 7)
    monkeypatch.setattr(N, "LEAST_PAIRS", 20)
    star = [(0, i, 2) for i in range(1, 40)] + [(i, 0, 2) for i in range(1, 40)] + [(5, 6, 3), (6, 5, 3)]
    pairs = spark.createDataFrame(star + star[:9], "v long, u long, w long")
    nb = N.Neighbours.of(pairs if weighted else pairs.select("v", "u"), len(star), {"odd": F.col("u") % 2})
    assert nb.parts == 2 and nb.pairs() == len(star) and nb.rows.where("v = 0").count() > 6
    before = spark.conf.get("spark.sql.adaptive.enabled")
    with N.dealt(spark, nb.parts):
        state = spark.range(40).select(F.col("id").alias("v"), (F.col("id") * 10).alias("x")).repartition("v").checkpoint()
        got = nb.sent(state)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
        assert sorted(map(tuple, got.select("u", "x", "w").collect())) == sorted((u, v * 10, w if weighted else 1) for v, u, w in star)
        assert {(r["u"], r["x"]) for r in nb.sent(state, F.col("odd") == 1).collect()} == {(u, v * 10) for v, u, _ in star if u % 2}
        assert {(r["u"], r["x"]) for r in nb.sent(state, upward=True).collect()} == {(u, v * 10) for v, u, _ in star if u > v}
    assert spark.conf.get("spark.sql.adaptive.enabled") == before


def test_labels_that_alternate_end(spark):
    """A star's labels change places for ever: the third round ends it."""
    e = spark.createDataFrame([(0, i) for i in range(1, 6)], "src long, dst long")
    assert G.label_propagation(e).count() == 6


def test_pagerank_carries_only_shares(spark, monkeypatch):
    """A hub in several rows, a dangling node, a node whose weights are 0; hashes and times are not kept for the rounds."""
    kept, ckpt = [], G._ckpt
    monkeypatch.setattr(G, "_ckpt", lambda df: kept.append(df.columns) or ckpt(df))
    monkeypatch.setattr("ledgerlens.operators.graph.ROW_ENDS", 3)
    edges = [(0, i, 1.0 + i) for i in range(1, 9)] + [(i, 0, 2.0) for i in range(1, 7)] + [(7, 3, 0.0)]
    rank = {v: 1 / 9 for v in range(9)}
    out = {v: sum(w for a, _, w in edges if a == v) for v in rank}
    for _ in range(3):
        lost = sum(rank[v] for v in rank if not out[v])
        rank = {v: 0.85 * sum(rank[a] * w / out[a] for a, b, w in edges if b == v and out[a]) + 0.85 * lost / 9 + 0.15 / 9 for v in rank}
    e = spark.createDataFrame([(a, b, w, 0, "h") for a, b, w in edges], "src long, dst long, weight double, ts long, tx_hash string")
    got = {r["node"]: r["pagerank"] for r in G.pagerank(e, fixed_iter=3).collect()}
    assert got == pytest.approx(rank)
    assert kept and not any("tx_hash" in c for c in kept)
