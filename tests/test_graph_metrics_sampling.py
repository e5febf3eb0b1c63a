"""Micro tables for graph, metric and sampling traps."""
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import graph as G
from ledgerlens.operators import metrics as M
from ledgerlens.operators import sampling as L

from conftest import tx_rows


def edges(spark, pairs):
    rows = [{"from_addr": a, "to_addr": b, "t": i, "value": w} for i, (a, b, w) in enumerate(pairs)]
    return G.build_edges(tx_rows(spark, rows))


def test_duplicate_edge_last_wins(spark):
    e = edges(spark, [("a", "b", 1.0), ("a", "b", 5.0)]).collect()
    assert len(e) == 1 and e[0]["weight"] == 5.0


def test_two_directions_one_undirected_edge(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "a", 1.0)])
    assert G.undirected(e).count() == 2
    assert {r["triangles"] for r in G.triangles(e).collect()} == {0}


def test_self_loop(spark):
    e = edges(spark, [("a", "a", 1.0), ("a", "b", 1.0)])
    c = {r["address"]: r for r in G.clustering_features(e).collect()}
    assert c["a"]["triangles"] == 0
    # a: neighbours {a (loop), b}, degree 1 + 2 = 3; b: degree 1 -> (3 + 1) / 3
    assert c["a"]["avg_neighbor_degree"] == pytest.approx(4 / 3)


def test_triangle_and_clustering(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("a", "d", 1.0)])
    c = {r["address"]: r for r in G.clustering_features(e).collect()}
    assert c["a"]["triangles"] == 1 and c["d"]["triangles"] == 0
    assert c["a"]["clustering_coefficient"] == pytest.approx(1 / 3)
    assert c["b"]["clustering_coefficient"] == pytest.approx(1.0)


def test_scam_distance_cases(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "s", 1.0), ("s", "x", 1.0)])
    scam = spark.createDataFrame([("s",)], "address string")
    d = {r["address"]: r["distance_to_scam"] for r in G.scam_distance(e, scam).collect()}
    assert d == {"a": 2, "b": 1, "s": 0, "x": 999}
    empty = spark.createDataFrame([], "address string")
    d0 = {r["distance_to_scam"] for r in G.scam_distance(e, empty).collect()}
    assert d0 == {999}
    n0 = G.scam_neighbors(e, empty).collect()
    assert {(r["scam_neighbor_count"], r["direct_scam_connection"]) for r in n0} == {(0, 0)}


def test_pagerank_sums_to_one(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 2.0), ("c", "a", 1.0), ("c", "d", 0.0)])
    pr = G.pagerank(e)
    assert pr.agg(F.sum("pagerank")).collect()[0][0] == pytest.approx(1.0, abs=1e-6)


def test_label_propagation_covers_all_nodes(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "a", 1.0), ("x", "y", 1.0)])
    com = G.label_propagation(e, 5)
    assert com.count() == 5
    q = G.modularity(e, com).collect()[0][0]
    singles = G.nodes_of(e).withColumn("community_id", F.monotonically_increasing_id())
    assert q >= G.modularity(e, singles).collect()[0][0]


def test_betweenness_path(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0)])
    bc = {r["address"]: r["betweenness"] for r in G.betweenness(e, G.nodes_of(e)).collect()}
    # b lies on the only a->c path; normalised by (n-1)(n-2) = 2
    assert bc["b"] == pytest.approx(0.5) and bc["a"] == 0.0 and bc["c"] == 0.0


def test_graph_features_hold_all_four_tables(spark):
    tx = tx_rows(spark, [dict(from_addr=a, to_addr=b, t=i) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("b", "d")])])
    scam = spark.createDataFrame([("d",)], "address string")
    got = {r["from_addr"]: r for r in G.graph_features(tx, scam).collect()}
    e = G.build_edges(tx)
    assert {a: r["pagerank_score"] for a, r in got.items()} == pytest.approx({r["node"]: r["pagerank"] for r in G.pagerank(e).collect()})
    assert {a: r["betweenness_centrality"] for a, r in got.items()} == pytest.approx(
        {r["address"]: r["betweenness"] for r in G.betweenness(e, G.nodes_of(e)).collect()})
    assert got["b"]["betweenness_centrality"] > 0
    assert {(a, r["community_id"], r["community_size"]) for a, r in got.items()} == {tuple(r) for r in G.label_propagation(e).collect()}
    assert got["b"]["distance_to_scam"] == 1 and got["b"]["triangles"] == 2


def test_risk_score_all_adds_the_centrality(spark):
    from ledgerlens.plans import QUERIES
    from ledgerlens.sources.tables import tx_view
    sf = "/root/testdata/sf0.001"
    with_it = {r["hash"]: r for r in QUERIES["risk_score_all"](spark, sf).collect()}
    without = {r["hash"]: r["risk_score"] for r in QUERIES["risk_vote"](spark, sf).collect()}
    assert len(with_it) == len(without) == tx_view(spark, sf).select("hash").distinct().count()
    assert all(with_it[h]["risk_score"] == pytest.approx(s + 0.1 * with_it[h]["centrality"], abs=2e-6) for h, s in without.items())
    assert max(r["centrality"] for r in with_it.values()) > 0


def test_registered_communities_settle(spark, monkeypatch):
    """A chain and a clique against brute force; 10 rounds leave the chain unsettled."""
    from collections import Counter

    from ledgerlens.plans import QUERIES, graph_queries
    pairs = [(i, i + 1) for i in range(30)] + [(a, b) for a in range(100, 106) for b in range(a + 1, 106)]
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    lab, before, rounds = {v: v for v in near}, None, 0
    while True:
        rounds += 1
        new = {v: min(Counter(lab[w] for w in near[v]).items(), key=lambda x: (-x[1], x[0]))[0] for v in near}
        done = new in (lab, before)
        before, lab = lab, new
        if done:
            break
    assert rounds > 10
    size = Counter(lab.values())
    number = {x: i for i, x in enumerate(sorted(size, key=lambda x: (-size[x], x)))}
    monkeypatch.setattr(graph_queries, "_edges", lambda s, sf: s.createDataFrame([(a, b, 1.0, 1) for a, b in pairs], "src long, dst long, weight double, tx_count long"))
    got = {tuple(r) for r in QUERIES["communities"](spark, "").collect()}
    assert got == {(v, number[x], size[x]) for v, x in lab.items()}


def test_pr_auc_with_ties(spark):
    s = spark.createDataFrame([(0.9, 1), (0.9, 0), (0.1, 0)], "score double, y int")
    r = M.pr_auc(s).collect()[0]
    assert r["pr_auc"] == pytest.approx(0.75)
    _, auc = M.roc(s)
    assert auc.collect()[0][0] == pytest.approx(0.75)


def test_no_positive_predictions(spark):
    s = M.with_predictions(spark.createDataFrame([(0.1, 1), (0.2, 0)], "score double, y int"))
    r = M.classification_scores(s).collect()[0]
    assert r["precision"] == 0.0 and r["f1"] == 0.0


def test_fold_arithmetic(spark):
    df = tx_rows(spark, [{"from_addr": "a", "t": i} for i in range(13)])
    f = {r["row_idx"]: r["test_fold"] for r in L.time_series_folds(df).collect()}
    assert [f[i] for i in range(3)] == [None, None, None]
    assert f[3] == f[4] == 0 and f[11] == f[12] == 4


def test_scaling_constant_column(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    st = L.standard_scaler_fit(df, ["x"])
    assert {r["x"] for r in L.standard_scaler_apply(df, st, ["x"]).collect()} == {0.0}


def test_downsample_exact_size(spark):
    df = spark.createDataFrame([(f"h{i}", 1 if i < 10 else 0) for i in range(100)], "hash string, y int")
    out = L.downsample(df, "y", "hash")
    assert out.count() == 30 and out.where("y = 1").count() == 10
    with pytest.raises(ValueError):
        L.downsample(df, "y", "hash", ratio=20)


def test_smote_and_adasyn_on_segments(spark):
    from ledgerlens.operators.oversampling import adasyn, smote, synthetic_on_segment
    rows = [(f"p{i}", 1, float(i % 5), float(i // 5)) for i in range(12)]
    rows += [(f"n{i}", 0, 10.0 + i % 7, float(i % 3)) for i in range(40)]
    df = spark.createDataFrame(rows, "hash string, y int, a double, b double")
    out = smote(df, "y", "hash", ["a", "b"], k=3)
    assert out.where("y = 1").count() == 40 and out.where("synthetic = 1").count() == 28
    assert synthetic_on_segment(out, df.where("y = 1"), "hash", ["a", "b"]).count() == 0
    ad = adasyn(df, "y", "hash", ["a", "b"], k=3)
    assert synthetic_on_segment(ad, df.where("y = 1"), "hash", ["a", "b"]).count() == 0


def test_betweenness_batches_equal_single_pass(spark):
    e = edges(spark, [("a", "b", 1.0), ("b", "c", 1.0), ("c", "d", 1.0), ("b", "d", 1.0), ("d", "a", 1.0)])
    one = {r["address"]: r["betweenness"] for r in G.betweenness(e, G.nodes_of(e)).collect()}
    two = {r["address"]: r["betweenness"] for r in G.betweenness(e, G.nodes_of(e), batch_size=2).collect()}
    assert one.keys() == two.keys()
    for a in one:
        assert one[a] == pytest.approx(two[a])


def test_model_zoo_trains_and_scores(spark):
    from ledgerlens.operators import models as ML
    rows = [(f"h{i}", i % 2, float(i % 2) + 0.1 * (i % 7), float(i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "hash string, y int, a double, b double")
    small = {"gbt": ML.gbt(5, 0.1, 3), "rf": ML.random_forest(trees=5, depth=4),
             "dt": ML.decision_tree(depth=4), "lr": ML.logistic(n=200)}
    for name, est in small.items():
        m = ML.fit(df, ["a", "b"], "y", est, scale=(name == "lr"))
        ev = ML.evaluate(ML.score(m, df, "y")).collect()[0]
        assert 0.0 <= ev["pr_auc"] <= 1.0 and ev["roc_auc"] > 0.9
    imp = ML.feature_importance(ML.fit(df, ["a", "b"], "y", small["dt"]), ["a", "b"]).collect()
    assert imp[0]["feature"] == "a"


def test_betweenness_in_blocks_and_batches_equals_brute_force(spark, monkeypatch):
    import random
    from collections import defaultdict, deque

    from ledgerlens.operators import blocks as B
    monkeypatch.setattr(B, "BLOCK_EDGES", 40)
    monkeypatch.setattr(B, "ROW_EDGES", 7)
    monkeypatch.setattr(B, "STATE_ROWS", 150)
    rnd = random.Random(1)
    pairs = [(rnd.randrange(40), rnd.randrange(40)) for _ in range(100)]
    after, nodes = defaultdict(set), sorted({x for e in pairs for x in e})
    for a, b in pairs:
        if a != b:
            after[a].add(b)
    pivots = nodes[::2]
    want = dict.fromkeys(nodes, 0.0)
    for p in pivots:
        dist, sigma, before, order, todo = {p: 0}, defaultdict(float, {p: 1.0}), defaultdict(list), [], deque([p])
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in after[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    todo.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
                    before[w].append(v)
        delta = defaultdict(float)
        for w in reversed(order):
            for v in before[w]:
                delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != p:
                want[w] += delta[w]
    n = len(nodes)
    scale = n / len(pivots) / ((n - 1) * (n - 2))
    e = spark.createDataFrame(pairs, "src bigint, dst bigint")
    got = {r["address"]: r["betweenness"] for r in G.betweenness(e, spark.createDataFrame([(p,) for p in pivots], "address bigint")).collect()}
    assert got == pytest.approx({v: x * scale for v, x in want.items()})


def test_clustering_carries_only_the_ends_of_edges(spark, monkeypatch):
    kept = []
    ckpt = G._ckpt
    monkeypatch.setattr(G, "_ckpt", lambda d: kept.append(d.columns) or ckpt(d))
    tx = tx_rows(spark, [dict(from_addr=a, to_addr=b, t=i) for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a"), ("a", "b"), ("c", "d")])])
    got = {r["address"]: r["triangles"] for r in G.clustering_features(G.build_edges(tx)).collect()}
    assert got == {"a": 1, "b": 1, "c": 1, "d": 0}
    assert kept == [["src", "dst"], ["u", "v"]]
