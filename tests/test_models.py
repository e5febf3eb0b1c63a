"""Attributions, staged early stop, importances and the tables derived from scores."""
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ledgerlens.operators import metrics as M
from ledgerlens.operators import models as ML
from ledgerlens.operators import trees

FEATURES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def data(spark):
    r = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c, d = (round(r.random(), 3) for _ in range(4))
        rows.append((f"h{i % 397}", a, b, c, 7.0 if i % 2 else float(round(d * 5)), int(a + b * c + r.random() * .4 > 1)))
    return spark.createDataFrame(rows, "hash string, a double, b double, c double, d double, y int").cache()


@pytest.fixture(scope="module")
def ensembles(data):
    out = {}
    for name, est in (("boosted", ML.gbt(6, 0.3, 4, 0.9, "0.8")), ("forest", ML.random_forest(4, 5)), ("tree", ML.decision_tree(5))):
        model = ML.fit(data, FEATURES, "y", est)
        out[name] = model, trees.node_table(model).cache()
    return out


def packed(nodes):
    return [t for arrays in trees._batches(nodes) for t in trees.trees_of(arrays)]


def expectation(tree, x, known, node=0):
    """Mean of the tree when only the features in ``known`` are seen: other splits are averaged by cover."""
    f = int(tree.feature[node])
    if f < 0:
        return float(tree.value[node])
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return expectation(tree, x, known, left if x[f] <= tree.threshold[node] else right)
    share = tree.cover[left] / tree.cover[node]
    return share * expectation(tree, x, known, left) + (1 - share) * expectation(tree, x, known, right)


def shapley(tree_list, x):
    n = len(x)
    out = [0.0] * n
    for f in range(n):
        rest = [g for g in range(n) if g != f]
        for k in range(n):
            w = math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
            for s in itertools.combinations(rest, k):
                out[f] += w * sum(expectation(t, x, {*s, f}) - expectation(t, x, set(s)) for t in tree_list)
    return out


@pytest.mark.parametrize("name", ["boosted", "forest", "tree"])
def test_tree_attributions_are_shapley_values(data, ensembles, name):
    _, nodes = ensembles[name]
    forest = packed(nodes)
    rows = trees.tree_attributions(data.limit(12), nodes, FEATURES).collect()
    for r in rows:
        assert r.contributions == pytest.approx(shapley(forest, [r.a, r.b, r.c, r.d]), abs=1e-9)
        assert r.base_value == pytest.approx(sum(expectation(t, None, set()) for t in forest), abs=1e-9)


@pytest.mark.parametrize("name", ["boosted", "forest", "tree"])
def test_contributions_add_up_to_the_margin_of_every_row(data, ensembles, name, monkeypatch):
    monkeypatch.setattr(trees, "BATCH_NODES", 40)  # several broadcasts
    monkeypatch.setattr(trees, "STEP_CELLS", 5_000)
    model, nodes = ensembles[name]
    got = trees.tree_attributions(trees.margins(data, nodes, FEATURES), nodes, FEATURES)
    column = "rawPrediction" if name == "boosted" else "probability"
    rows = model.transform(got).select("margin", "base_value", "contributions", vector_to_array(column)[1].alias("m")).collect()
    assert len(rows) == 400  # rows with one hash are rows of their own
    for r in rows:
        assert r.margin == pytest.approx(r.m, abs=1e-9) and r.base_value + sum(r.contributions) == pytest.approx(r.m, abs=1e-9)


def test_missing_values_go_right():
    t = trees.Tree(np.array([0, -1, 1, -1, -1]), np.array([.5, 0, .5, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]),
                   np.array([0, 1., 0, 2., 4.]), np.array([10., 4, 6, 3, 3]))
    x = np.array([[np.nan, .1], [.2, np.nan], [np.nan, np.nan], [.5, 0]])
    assert t.margin(x).tolist() == [2, 1, 4, 1]
    out = np.zeros((4, 2))
    t.add_attributions(x, out)
    assert (out.sum(axis=1) + t.base()).tolist() == pytest.approx([2, 1, 4, 1])


def test_single_leaf_has_no_contributions(spark):
    nodes = spark.createDataFrame([(0, 0, -1, None, -1, -1, 0.25, 9.0, 9, None)], trees.NODE_SCHEMA)
    r = trees.tree_attributions(spark.createDataFrame([(1.0,)], "a double"), nodes, ["a"]).first()
    assert (r.base_value, r.contributions) == (0.25, [0.0])


def test_empty_table(spark, ensembles):
    none = spark.createDataFrame([], "a double, b double, c double, d double, y int")
    nodes = ensembles["boosted"][1]
    assert trees.tree_attributions(none, nodes, FEATURES).collect() == [] and trees.staged_margins(none, nodes, FEATURES).collect() == []


def pr_auc(pairs):
    """Trapezoid over distinct scores from (recall 0, precision 1)."""
    total = sum(y for y, _ in pairs)
    area, r0, p0 = 0.0, 0.0, 1.0
    for s in sorted({s for _, s in pairs}, reverse=True):
        tp = sum(y for y, v in pairs if v >= s)
        r, p = tp / total, tp / sum(v >= s for _, v in pairs)
        area += (r - r0) * (p + p0) / 2
        r0, p0 = r, p
    return area


def test_early_stop_keeps_the_best_prefix(data, monkeypatch):
    monkeypatch.setattr(trees, "BATCH_NODES", 60)
    train, validation = data.where("a < 0.7 or b < 0.3"), data.where("not (a < 0.7 or b < 0.3)")
    nodes, curve, chosen = ML.boosted(train, validation, FEATURES, "y", ML.gbt(9, 0.3, 3, 1.0, "all"), patience=3)
    got = {r["round"]: r.pr_auc for r in curve.collect()}
    # Brute force over all prefixes, each scored by itself.
    model = ML.fit(ML.weighted(train, "y"), FEATURES, "y", ML.gbt(9, 0.3, 3, 1.0, "all").setWeightCol("_weight"))
    every = trees.node_table(model)
    want = {}
    for n in range(1, 10):
        scored = ML.score_nodes(validation, trees.prefix(every, n), FEATURES, "y").collect()
        want[n] = pr_auc([(r.y, round(r.score, 12)) for r in scored])
    assert got == pytest.approx(want, abs=1e-9)
    assert chosen == ML.stopping_round(sorted(want.items()), 3) and nodes.select("tree").distinct().count() == chosen


def test_stopping_round():
    assert ML.stopping_round([(1, .5), (2, .6), (3, .6), (4, .55), (5, .9)], 2) == 2
    assert ML.stopping_round([(1, .5), (2, .6), (3, .6), (4, .55), (5, .9)], 3) == 5
    assert ML.stopping_round([(1, 0.0)], 10) == 1


def test_class_weight(data):
    n = {r.y: r["count"] for r in data.groupBy("y").count().collect()}
    got = {r.y: r._weight for r in ML.weighted(data, "y").select("y", "_weight").distinct().collect()}
    assert got == {0: 1.0, 1: n[0] / n[1]}


def test_importances_equal_sql_over_the_node_table(ensembles, tmp_path):
    for name in ("boosted", "forest"):
        nodes = ensembles[name][1]
        path = str(tmp_path / name)
        nodes.write.parquet(path)
        want = duckdb.sql(f"""select feature, count(*) as weight, avg(gain * cover) as gain, avg(cover) as cover
                              from '{path}/*.parquet' where feature >= 0 group by feature""").fetchall()
        got = {r.feature: (r.weight, r.gain, r.cover) for r in trees.importances(nodes, [*FEATURES, "unused"]).collect()}
        assert got.pop("unused") == (0, 0.0, 0.0)
        for f, *rest in want:
            assert got.pop(FEATURES[f]) == pytest.approx(tuple(rest))
        assert all(v == (0, 0.0, 0.0) for v in got.values())


# ---- linear attributions and what is made of them


@pytest.fixture(scope="module")
def explained(data):
    model = ML.fit(data, FEATURES, "y", ML.logistic(n=400), scale=True)
    return model, ML.linear_attributions(model, ML.with_score(model, data, "y"), FEATURES).cache()


def test_linear_contributions_add_up(explained, tmp_path):
    model, rows = explained
    for r in model.transform(rows).select("base_value", "contributions", vector_to_array("rawPrediction")[1].alias("m")).collect():
        assert r.base_value + sum(r.contributions) == pytest.approx(r.m, abs=1e-9)
    from pyspark.ml import PipelineModel
    model.write().save(str(tmp_path / "m"))
    again, want = (ML.linear_terms(m, FEATURES) for m in (PipelineModel.load(str(tmp_path / "m")), model))
    assert again == want  # the scaling constants are part of the saved model


def test_scaling_uses_population_deviations(explained, data):
    terms, _ = ML.linear_terms(explained[0], FEATURES)
    st = data.agg(*[F.avg(f) for f in FEATURES], *[F.stddev_pop(f) for f in FEATURES]).first()
    assert [t[2] for t in terms] == pytest.approx(st[:4]) and [t[3] for t in terms] == pytest.approx(st[4:])


def test_constant_feature(spark, data):
    d = data.withColumn("k", F.lit(3.0))
    model = ML.fit(d, ["a", "k"], "y", ML.logistic(n=400), scale=True)
    rows = ML.linear_attributions(model, d, ["a", "k"])
    assert {r.contributions[1] for r in rows.collect()} == {0.0}
    assert {r.interaction_feature for r in ML.dependence(rows, ["a", "k"], "a").collect()} == {"k"}


def test_global_importance(explained):
    rows = explained[1].collect()
    got = ML.global_importance(explained[1], FEATURES).collect()
    want = {f: np.mean([abs(r.contributions[i]) for r in rows]) for i, f in enumerate(FEATURES)}
    assert [r.feature for r in got] == sorted(want, key=lambda f: -want[f])
    assert {r.feature: r.mean_abs_contribution for r in got} == pytest.approx(want)


def test_top_features_and_table(explained):
    rows = explained[1].collect()
    top = ML.top_features_per_row(explained[1], FEATURES, n=2).collect()
    assert len(top) == 2 * len(rows) and {r["rank"] for r in top} == {1, 2}
    one = rows[5]
    want = sorted(zip(FEATURES, one.contributions), key=lambda p: (-abs(p[1]), p[0]))[:2]
    got = sorted((r for r in top if r.hash == one.hash and r.feature in dict(want) and r.contribution == dict(want)[r.feature]), key=lambda r: r["rank"])
    assert [(r.feature, r.contribution, r.direction) for r in got][:2] == [(f, c, "increases" if c > 0 else "decreases") for f, c in want]
    table = ML.attribution_table(explained[1], FEATURES).collect()
    assert len(table) == 4 * len(rows)  # repeated hashes are not joined with each other
    assert {(r.hash, r.predicted_label, r.predicted_proba) for r in table} == {(r.hash, r.pred, r.score) for r in rows}


def test_zero_contribution_decreases(spark):
    d = ML.linear_contributions(spark.createDataFrame([("x", 1.0, None)], "hash string, a double, b double"), [("a", 2.0, 1.0, 1.0), ("b", 1.0, 0.0, 1.0)], 0.5)
    assert [(r.feature, r.direction, r.value) for r in ML.top_features_per_row(d, ["a", "b"]).collect()] == [("a", "decreases", 1.0), ("b", "decreases", None)]


def test_waterfall(explained):
    one = explained[1].where("hash = 'h200'").first()
    got = sorted(ML.waterfall(explained[1], FEATURES, "h200", n=3).collect(), key=lambda r: r["rank"])
    want = sorted(zip(FEATURES, one.contributions), key=lambda p: -abs(p[1]))[:3]
    assert [r.feature for r in got] == [f for f, _ in want]
    assert [r.cumulative for r in got] == pytest.approx(np.cumsum([one.base_value] + [c for _, c in want])[1:].tolist())


def test_dependence(explained):
    rows = explained[1].collect()
    c = np.array([r.contributions[0] for r in rows])
    best = max(FEATURES[1:], key=lambda f: abs(np.corrcoef(c, [r[f] for r in rows])[0, 1]))
    got = ML.dependence(explained[1], FEATURES, "a").collect()
    assert len(got) == 400 and {r.interaction_feature for r in got} == {best}
    assert sorted((r.value, r.interaction_value) for r in got) == sorted((r.a, r[best]) for r in rows)


def test_evaluation_equals_sql_over_the_score_table(explained, tmp_path):
    path = str(tmp_path / "scores")
    explained[1].select("y", "score", "pred").write.parquet(path)
    tp, fp, fn, tn = duckdb.sql(f"""select count(*) filter (y = 1 and pred = 1), count(*) filter (y = 0 and pred = 1),
                                           count(*) filter (y = 1 and pred = 0), count(*) filter (y = 0 and pred = 0) from '{path}/*.parquet'""").fetchall()[0]
    ev = ML.evaluate(explained[1]).first()
    assert (ev.tp, ev.fp, ev.fn, ev.tn) == (tp, fp, fn, tn)
    assert ev.pr_auc == pytest.approx(pr_auc([(r.y, r.score) for r in explained[1].collect()]))


def test_curves_by_group(spark):
    rows = [("x", 1, .9), ("x", 0, .9), ("x", 0, .1), ("y", 1, .2), ("y", 1, .8), ("y", 0, .5)]
    d = spark.createDataFrame(rows, "g string, y int, score double")
    got = {r.g: r.pr_auc for r in M.pr_auc(d, by=("g",)).collect()}
    assert got == pytest.approx({g: pr_auc([(y, s) for h, y, s in rows if h == g]) for g in "xy"})


def test_bounded_fit_rows(data):
    got = ML.fit_rows(data, ["hash"], 50)
    assert got.count() == 50 and got.columns == data.columns and got.rdd.getNumPartitions() == 1
